"""Shared one-pass intermediates: per-column aggregates, value counts, group matching."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from assayer.functions import text
from assayer.session import shared_folder

# A group holding more than 1/HOT_SHARE of all rows is hot. At most HOT_SHARE
# groups per counted column can be, which is what bounds the broadcast below.
HOT_SHARE = 1000
# Nor may a group have more rows than this without being hot, however large the
# table: total / HOT_ROWS more groups at most.
HOT_ROWS = 10_000_000


def analysed_columns(df: DataFrame, row_key: Sequence[str] = ()) -> list[str]:
    """Columns an operator looks at: all but the row key. Nested columns are refused."""
    for field in df.schema.fields:
        if field.name not in row_key and isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise TypeError(f"column {field.name!r} is nested; flatten it or leave it out first")
    return [c for c in df.columns if c not in row_key]


def column(name: str) -> Column:
    """Reference by exact name, also when it holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: floating-point NaN becomes NULL, other columns stay untouched."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({
        c: F.nanvl(column(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats
    }) if floats else df


def aggregate_columns(df: DataFrame, metrics: Mapping[str, Mapping[str, Column]], key: str = "column",
                      constants: Mapping[str, Mapping[str, Column]] | None = None) -> DataFrame:
    """Aggregate many columns in one pass and return one row per column.

    ``metrics`` maps a column name to ``{metric: aggregate expression}``; every
    column must name the same metrics. ``constants`` adds fields that need no
    aggregation.
    """
    wide, rows = [], []
    for i, (name, exprs) in enumerate(metrics.items()):
        fields = [F.lit(name).alias(key)]
        fields += [value.alias(field) for field, value in (constants or {}).get(name, {}).items()]
        for metric, expr in exprs.items():
            wide.append(expr.alias(f"c{i}_{metric}"))
            fields.append(F.col(f"c{i}_{metric}").alias(metric))
        rows.append(F.struct(*fields))
    return df.agg(*wide).select(F.inline(F.array(*rows)))


def settle(df: DataFrame) -> DataFrame:
    """Run a report-sized frame once and keep its rows as a local relation.

    Only for results bounded by the number of columns (or column pairs), so that
    rules stacked on a report do not run its jobs again.
    """
    return local_rows(df.sparkSession, df.collect(), df.schema)


def local_rows(spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType) -> DataFrame:
    """Driver-side report rows as a local relation (through Arrow, no Python worker)."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrow = to_arrow_schema(fields)
    arrays = [
        pa.array([list(v.items()) if isinstance(v, dict) else v for v in values], type=f.type)
        for values, f in zip(columns, arrow)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=fields)


def report(spark: SparkSession, rows: Sequence[Mapping], schema: str) -> DataFrame:
    """The same from records; a field a record lacks is NULL."""
    names = T._parse_datatype_string(schema).names
    return local_rows(spark, [[r.get(n) for n in names] for r in rows], schema)


def long_values(df: DataFrame, values: Mapping[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Columns turned into ``(keep..., column, value)`` rows, value as text."""
    pairs = [
        F.struct(F.lit(c).alias("column"), v.cast("string").alias("value")) for c, v in values.items()
    ]
    return df.select(*[column(k) for k in keep], F.inline(F.array(*pairs)))


def value_counts(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Frequency table ``(column, value, n)`` over non-null values.

    Counting is combined map-side, so a hot value costs one row per task in the
    shuffle.
    """
    return (
        long_values(df, values)
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def empty_counts(spark: SparkSession) -> DataFrame:
    return local_rows(spark, [], "column string, value string, n long")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def matching_rows(rows: DataFrame, counts: DataFrame, keys: Sequence[str], wanted: Column,
                  total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of the groups in ``counts`` for which ``wanted`` holds.

    ``counts`` has one row per group with its size ``n``; ``total`` is the number
    of rows counted. The groups that matter are staged once, so the join knows
    their true size and shuffles the rows only if they are too many to
    broadcast. Hot groups, of which there are few by definition, are matched
    against a broadcast and taken out before that shuffle, so no group can fill
    a partition. Keys compare null-safe.
    """
    is_hot = (F.col("n") * HOT_SHARE > F.lit(total)) | (F.col("n") > hot_rows)
    marked = stage(counts.where(is_hot | wanted).select(*keys, is_hot.alias("__hot"), wanted.alias("__wanted")))

    def on(other: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [rows[k].eqNullSafe(other[k]) for k in keys])

    hot = marked.where("__hot").select(*keys)
    rare = marked.where("NOT __hot AND __wanted").select(*keys)
    if hot.isEmpty():
        return rows.join(rare, on(rare), "left_semi")
    hot_wanted = marked.where("__hot AND __wanted").select(*keys)
    cool = rows.join(F.broadcast(hot), on(hot), "left_anti").join(rare, on(rare), "left_semi")
    if hot_wanted.isEmpty():
        return cool
    return rows.join(F.broadcast(hot_wanted), on(hot_wanted), "left_semi").unionByName(cool)


_staged: list[tuple[SparkSession, str]] = []


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table once and read it back, for frames several jobs start from.

    The table goes to the session's shared folder, so it survives lost executors,
    cuts the lineage, and later jobs read only the columns they need. It stays
    until ``release_staged``, or until the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/assayer-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release_staged() -> None:
    """Remove what this process has staged. Frames that read from it can't be used afterwards."""
    while _staged:
        spark, path = _staged.pop()
        with contextlib.suppress(Exception):  # the session may have ended before
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def approx_distincts(df: DataFrame, values: Mapping[str, Column]) -> tuple[int, dict[str, int], dict[str, int]]:
    """Row count, non-null counts and approximate distinct counts, in one narrow pass."""
    if not values:
        return df.count(), {}, {}
    exprs = [F.count(F.lit(1)).alias("rows")]
    for i, v in enumerate(values.values()):
        exprs += [F.count(v).alias(f"n{i}"), F.approx_count_distinct(v).alias(f"d{i}")]
    got = df.agg(*exprs).first()
    return (
        got["rows"],
        {c: got[f"n{i}"] for i, c in enumerate(values)},
        {c: got[f"d{i}"] for i, c in enumerate(values)},
    )


def exact_distincts(df: DataFrame, values: Mapping[str, Column]) -> dict[str, int]:
    """Exact distinct counts of several columns in one query.

    Values are compared by a 128-bit digest, one short row per cell, so no row is
    widened to all columns; repeats are combined map-side.
    """
    if not values:
        return {}
    cells = df.select(F.inline(F.array(*[cell_digest(i, v) for i, v in enumerate(values.values())]))).where("__there")
    distinct = cells.groupBy("__column", *DIGEST).agg(F.lit(1).alias("__one"))
    got = {r["__column"]: r["n"] for r in distinct.groupBy("__column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: got.get(i, 0) for i, c in enumerate(values)}


def cell_digest(number: int, value: Column) -> Column:
    """Column number, whether there is a value, and the value's digest."""
    # By text form, in which equal values of one type are equal, but for the two zeros of doubles.
    plain = F.when(value.cast("string") == "-0.0", F.lit("0.0")).otherwise(value.cast("string"))
    return F.struct(F.lit(number).alias("__column"), value.isNotNull().alias("__there"),
                    F.xxhash64(plain).alias(DIGEST[0]), F.xxhash64(F.lit("cell"), plain).alias(DIGEST[1]))


# Columns of a row's digest: two hashes of 64 bits.
DIGEST = ("__digest_1", "__digest_2")


def row_digest(values: Sequence[tuple[Column, T.DataType]]) -> tuple[Column, Column]:
    """128 bits of a row: equal rows have equal digests, NULL is a value of its own."""
    parts = []
    for v, kind in values:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            v = v + F.lit(0.0)  # one zero
        parts += [v.isNull(), v]
    return F.xxhash64(*parts), F.xxhash64(F.lit("row"), *parts)


def with_digest(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and the digest of the other columns."""
    one, two = row_digest([(column(c), df.schema[c].dataType) for c in columns])
    return df.select(*[column(k) for k in keep], one.alias(DIGEST[0]), two.alias(DIGEST[1]))


def is_text(df: DataFrame, name: str) -> bool:
    return text.is_string(dtype(df, name))
