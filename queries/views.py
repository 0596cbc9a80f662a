"""Inputs of the registered queries.

The given tables are clean, so the operators that react to dirt read a "dirty"
view: every row of a table with faults put in by rules on its key, plus a second
copy of some rows. One SQL text serves both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

_ORDER_COLUMNS = """
    CASE WHEN o_orderkey % 211 = 5 THEN NULL ELSE concat('ORD-', CAST(o_orderkey AS STRING)) END AS order_id,
    o_custkey AS customer_id,
    CASE WHEN o_orderkey % 13 = 1 THEN lower(o_orderstatus)
         WHEN o_orderkey % 17 = 2 THEN concat(' ', o_orderstatus, ' ')
         WHEN o_orderkey % 29 = 3 THEN 'unknown'
         WHEN o_orderkey % 4999 = 7 THEN concat('rare-', CAST(o_orderkey AS STRING))
         ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 19 = 1 THEN NULL
         WHEN o_orderkey % 43 = 2 THEN 'n/a'
         WHEN o_orderkey % 107 = 9 THEN '?'
         WHEN o_orderkey % 101 = 3 THEN CAST(-CAST(round(o_totalprice) AS BIGINT) AS STRING)
         WHEN o_orderkey % 103 = 4 THEN CAST(CAST(round(o_totalprice * 50) AS BIGINT) AS STRING)
         ELSE CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING) END AS price,
    CASE WHEN o_orderkey % 31 = 1 THEN NULL
         WHEN o_orderkey % 37 = 2 THEN 'not a date'
         ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS order_date,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 41 = 0 THEN NULL
         WHEN o_orderpriority LIKE '1%' THEN 'Yes' ELSE 'no' END AS is_urgent,
    CASE WHEN o_orderkey % 11 = 3 THEN NULL
         WHEN o_orderkey % 107 = 1 THEN -(o_custkey % 50) - 1
         ELSE o_custkey % 50 + 1 END AS quantity,
    'web' AS channel,
    CASE WHEN o_orderkey % 40 = 0 THEN 'export' ELSE 'domestic' END AS market
"""

DIRTY_ORDERS = f"""
SELECT o_orderkey * 2 AS row_id, {_ORDER_COLUMNS} FROM orders
UNION ALL
SELECT o_orderkey * 2 + 1 AS row_id, {_ORDER_COLUMNS} FROM orders WHERE o_orderkey % 53 = 0
"""

DIRTY_COLUMNS = ("order_id", "customer_id", "status", "price", "order_date", "priority", "is_urgent",
                 "quantity", "channel", "market")
DIRTY_TYPES = {
    "order_id": "Identifier", "customer_id": "Identifier", "status": "Categorical", "price": "Numerical",
    "order_date": "Datetime", "priority": "Categorical", "is_urgent": "Boolean", "quantity": "Numerical",
    "channel": "Categorical", "market": "Categorical",
}

# Columns that can all be missing, some of them together.
SPARSE_ORDERS = """
SELECT o_orderkey AS row_id,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 11 = 1 THEN NULL ELSE o_totalprice END AS price,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS order_date,
    CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'N/A' ELSE o_orderpriority END AS priority
FROM orders
"""

# Dates written day first, amounts with currency marks, descriptions with outer blanks.
WRITTEN_ORDERS = """
SELECT o_orderkey AS row_id,
    concat(CAST(extract(day FROM o_orderdate) AS STRING), '/', CAST(extract(month FROM o_orderdate) AS STRING), '/',
           CAST(extract(year FROM o_orderdate) AS STRING)) AS placed,
    CASE WHEN o_orderkey % 9 = 0 THEN CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING)
         WHEN o_orderkey % 50 = 1 THEN 'on request'
         ELSE concat('$', CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), ',000') END AS amount,
    CASE WHEN o_orderkey % 6 = 0 THEN concat(' ', o_orderpriority, ' ')
         WHEN o_orderkey % 10 = 1 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS note
FROM orders
"""

# Thirty-five number columns, each a mix of two values of the row.
WIDE_NUMBERS = tuple(f"x{i:02d}" for i in range(35))
WIDE_LINEITEM = "SELECT " + ", ".join(
    f"CAST(l_quantity * {i + 1} + (l_orderkey * {2 * i + 3} + l_linenumber) % {17 + i} AS DOUBLE) AS {c}" for i, c in enumerate(WIDE_NUMBERS)
) + " FROM lineitem"

LINEITEM_TYPES = {
    "l_orderkey": "Identifier", "l_partkey": "Identifier", "l_suppkey": "Identifier",
    "l_linenumber": "Numerical", "l_quantity": "Numerical", "l_extendedprice": "Numerical",
    "l_discount": "Numerical", "l_tax": "Numerical", "l_returnflag": "Categorical",
    "l_linestatus": "Categorical", "l_shipdate": "Datetime",
}
LINEITEM_NUMBERS = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view of this module over the orders table."""
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def register_tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
