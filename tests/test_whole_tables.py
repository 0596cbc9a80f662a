"""Nothing is cut: long identifiers, wide tables, late values, row lists behind findings."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.operators import anomalies, charts, eda, findings, frames, templates
from assayer.operators.anomalies import Table
from assayer.session import shared_folder
from assayer.sources import readers


def test_long_whole_numbers_survive_a_csv_scan(spark, tmp_path):
    path = tmp_path / "ids.csv"
    ids = [9_007_199_254_740_993 + i for i in range(3)]
    rows = [f"{9_223_372_036_854_775_800 + i},{10**19 + i},{ids[i]}.5,{ids[i]}" for i in range(3)]
    path.write_text("\n".join(["fits,beyond,point,whole", *rows]))
    df = readers.load_dataset(spark, str(path))
    assert dict(df.dtypes) == {"fits": "bigint", "beyond": "string", "point": "double", "whole": "bigint"}
    assert df.select("fits").distinct().count() == df.select("beyond").distinct().count() == df.select("whole").distinct().count() == 3


def test_correlations_of_a_wide_table(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({f"x{i:02d}": rng.normal(1e6, 5, 200) for i in range(33)})
    data["x00"] = data["x32"] * 2 + rng.normal(0, 1, 200)
    data.loc[::7, "x05"] = None
    data["flat"] = 3.3
    df = spark.createDataFrame(data).repartition(3)
    pairs = {(r.column_1, r.column_2): r for r in eda.correlation_pairs(df, {c: "Numerical" for c in data}).collect()}
    assert len(pairs) == 33 * 32 // 2 and not any("flat" in p for p in pairs)
    expected = data.corr()
    assert all(r.correlation == pytest.approx(expected.loc[a, b], abs=1e-9) for (a, b), r in pairs.items())
    assert pairs["x05", "x06"].observations == data["x05"].notna().sum()
    pivot = charts.matrix_pivot(charts.heatmap(Table(df, {c: "Numerical" for c in data})), "y", "x", "correlation")
    assert len(pivot.columns) == 34 and pivot.count() == 33


def test_findings_tell_of_every_column(spark):
    values = [1.0] * 40 + [500.0]
    df = spark.createDataFrame(pd.DataFrame({**{f"a{i:02d}": range(41) for i in range(11)}, "late": values, **{f"t{i:02d}": ["x"] * 41 for i in range(12)}}))
    found = findings.statistical_findings(Table(df)).collect()
    assert any(r.type == "skewness" and r.column == "late" for r in found)
    assert sum(r.type == "category_distribution" for r in found) == 12


def test_schema_context_reads_the_whole_table(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id >= 4000 THEN concat('v', id % 7) END AS late")
    got = {r.column: list(r.samples) for r in templates.schema_context(df).collect()}
    assert got == {"id": ["0", "1", "10", "100", "1000"], "late": [f"v{i}" for i in range(5)]}


def test_rows_behind_findings(spark):
    rows = [(i, "A" if i else "B", float(i % 5) if i != 7 else 1000.0, "2024-01-02" if i != 3 else "soon") for i in range(120)]
    rows += [(500, "A", 2.0, "2024-01-02"), (501, None, None, None)]
    df = spark.createDataFrame(rows, "k long, city string, x double, day string")
    types = {"city": "Categorical", "x": "Numerical", "day": "Datetime"}
    issues = {(r.k, r.column, r.issue) for r in anomalies.row_issues(df, types, ["k"]).collect()}
    assert {(0, "city", "rare_category"), (7, "x", "outlier"), (7, "x", "extreme_outlier"), (3, "day", "invalid_date")} <= issues
    assert {(501, None, "mostly_empty"), (501, "x", "missing_cell"), (500, None, "duplicate_row")} <= issues
    scored = {r.k: r.anomaly_score for r in anomalies.suspicious_rows(df, types, ["k"]).collect()}
    assert scored[501] == 2 and scored[0] == 1


def test_digest_tells_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, 0.0), (None, "a", 0.0), ("a", None, -0.0), (None, None, None)], "x string, y string, z double")
    assert frames.with_digest(df, df.columns).distinct().count() == 3
    assert frames.exact_distincts(df, {"x": df["x"], "z": df["z"]}) == {"x": 1, "z": 1}


def test_staged_tables_can_be_released(spark):
    staged = frames.stage(spark.range(3).toDF("a"))
    path = staged.inputFiles()[0]
    assert shared_folder(spark) in path and staged.count() == 3
    frames.release_staged()
    with pytest.raises(Exception, match="not exist|NOT_EXIST"):
        spark.read.parquet(path).count()


def test_a_group_of_a_small_share_can_be_hot(spark):
    total = 20_000
    rows = spark.range(total).selectExpr("CASE WHEN id % 2000 = 0 THEN 'often' ELSE concat('v', id % 9000) END AS v", "id")
    counts = rows.groupBy("v").agg(F.count("*").alias("n"))
    for bound in (5, frames.HOT_ROWS):
        got = frames.matching_rows(rows, counts, ["v"], F.col("n") == 10, total, bound)
        assert got.count() == 10 and {r.v for r in got.collect()} == {"often"}
