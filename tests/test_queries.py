"""Registered queries against their reference SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from queries.views import TABLES
from tools.check_queries import normal

SF = "/root/testdata/sf0.001"
CHECKED = (
    "schema_profile_dirty", "missing_by_column", "iqr_outliers", "suspicious_rows", "anomaly_issues", "quality_score",
    "consistency", "clean_result", "clean_log", "numeric_profile", "categorical_profile", "correlations",
    "category_numeric_groups", "cramers_v", "time_trend", "histogram", "statistical_findings", "exact_quantiles", "sql_cube",
    "row_issues", "wide_pivot", "csv_round_trip", "schema_context", "json_records", "result_chart_heatmap",
)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, name):
    got = normal(entry.queries()[name](spark, SF).toPandas())
    want = normal(con.execute(entry.oracle_sql()[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 5
