import itertools
import math

import pytest
from pyspark.sql import functions as F

from assayer.operators import charts, eda, findings, templates
from assayer.operators.anomalies import Table


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, 20.0 + i, 1000.0 * i if i < 11 else 9999999.0, 50.0 - i, ("Delhi", "Mumbai", "Pune")[i % 3],
             f"2024-{i:02d}-01", "Yes" if i % 2 else "No") for i in range(1, 12)]
    df = spark.createDataFrame(rows, "customer_id long, age double, income double, score double, city string, d string, active string")
    df = df.withColumn("signup", F.to_timestamp("d").cast("timestamp_ntz")).drop("d")
    return Table(df, {"customer_id": "Identifier", "age": "Numerical", "income": "Numerical", "score": "Numerical",
                      "city": "Categorical", "active": "Categorical", "signup": "Datetime"}, ["customer_id"])


def test_correlations(people):
    got = {(r["column_1"], r["column_2"]): r for r in eda.ranked_correlations(eda.correlation_pairs(people)).collect()}
    assert got["age", "score"]["correlation"] == -1.0 and got["age", "score"]["strength"] == "very strong"
    assert got["age", "score"]["direction"] == "negative" and len(got) == 3


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 1.0, float("inf") if i == 0 else float(-i)) for i in range(6)], "a double, b double, c double")
    got = eda.correlation_pairs(df, {c: "numeric" for c in "abc"}).collect()
    assert [(r["column_1"], r["column_2"], r["observations"]) for r in got] == [("a", "c", 5)]


def test_categorical_profile(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)] * 2 + [(None,)] + [("c",)] * 4, "c string").withColumn("e", F.lit(None).cast("string"))
    got = {r["column"]: r for r in eda.categorical_profile(df, {"c": "category", "e": "category"}).collect()}
    p = [0.25, 0.25, 0.5]
    assert got["c"]["entropy"] == 1.5 == -sum(x * math.log2(x) for x in p)
    assert got["c"]["normalized_entropy"] == round(1.5 / math.log2(3), 6)
    assert (got["c"]["most_common"], got["c"]["dominance_percentage"], got["c"]["missing_count"]) == ("c", 50.0, 1)
    assert got["e"]["count"] == 0 and got["e"]["entropy"] is None and got["e"]["missing_percentage"] == 100.0


def test_effect_size(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0), ("b", 9.0), ("lonely", 100.0)], "g string, x double")
    got = eda.category_numeric_effects(eda.category_numeric_moments(df, {"g": "category", "x": "number"})).first()
    # Kept groups a and b: between 36, within 4.
    assert got["effect_size"] == 0.9 and got["highest_mean_group"] == "b" and got["mean_difference"] == 6.0


def test_cramers_v(spark):
    df = spark.createDataFrame([("x", "u", "p")] * 3 + [("y", "v", "p")] * 3 + [("x", "v", "q")] * 0 + [("y", "v", "q")], "a string, b string, c string")
    got = {(r["column_1"], r["column_2"]): r["cramers_v"] for r in eda.cramers_v(eda.crosstabs(df, {c: "category" for c in "abc"})).collect()}
    assert got["a", "b"] == 1.0
    chi2 = sum((o - e) ** 2 / e for o, e in ((3, 18 / 7), (0, 3 / 7), (3, 24 / 7), (1, 4 / 7)))
    assert got["a", "c"] == round(math.sqrt(chi2 / 7), 6)


def test_time_trend(people):
    got = {r["numerical_column"]: r for r in eda.time_trends(people).collect()}
    assert got["age"]["direction"] == "increasing" and got["score"]["direction"] == "decreasing"
    assert (got["age"]["first_value"], got["age"]["last_value"], got["age"]["percentage_change"]) == (21.0, 31.0, 47.619048)


def test_co_missing(spark):
    df = spark.createDataFrame([(None, None, 1)] * 3 + [(None, 1, 1)] + [(1, 1, None)], "a int, b int, c int")
    got = eda.co_missing_pairs(df).collect()
    assert [(r["column_1"], r["column_2"], r["both_missing"], r["jaccard_similarity"]) for r in got] == [("a", "b", 3, 0.75)]


def test_report_composes(people):
    report = eda.EdaReport(people)
    assert report.overview.first()["rows"] == 11
    assert {r["type"] for r in report.important_relationships.collect()} >= {"numeric_correlation", "time_trend"}
    assert {r["column"] for r in report.flags.collect()} == {"income"}
    context = findings.profile_context(report, ["age", "signup", "nothing"])
    assert ("numerical", "age", "count", "11") in {tuple(r) for r in context.collect()}


def test_histogram_totals(people, spark):
    rows = charts.histogram(people, "age").collect()
    assert len(rows) == 5 and sum(r["frequency"] for r in rows) == 11
    gaps = spark.createDataFrame([(0.0,), (10.0,), (None,), (2.0,), (2.0,)], "x double")
    assert [r["frequency"] for r in charts.histogram(gaps, "x").collect()] == [3, 0, 0, 0, 1]  # right-closed, empty bins kept
    same = spark.createDataFrame([(2.5,)] * 4, "x double")
    assert [(r["bin"], r["frequency"]) for r in charts.histogram(same, "x").collect()] == [("2.5", 4)]


def test_heatmap_and_pivot(people):
    cells = charts.heatmap(people)
    assert cells.count() == 9
    assert charts.matrix_pivot(cells, "y", "x", "correlation").columns == ["y", "age", "income", "score"]


def test_box_outlier(spark):
    df = spark.createDataFrame([(float(v),) for v in (10, 11, 12, 13, 14, 1000)], "x double")
    row = charts.box_stats(df, "x").first()
    assert row["outlier_count"] == 1 and row["outliers"] == [1000.0]


def test_automatic_charts(people):
    chosen = charts.automatic_charts(people)
    assert 0 < len(chosen) <= 10 and len({c.signature for c in chosen}) == len(chosen)
    assert all("customer_id" not in (c.x, c.y) for c in chosen)
    assert [c.score for c in chosen] == sorted((c.score for c in chosen), reverse=True)
    assert all(c.data.count() > 0 for c in chosen)


def test_result_charts(people):
    df = people.df
    kind = lambda *a, **k: getattr(charts.result_chart(*a, **k), "chart_type", None)
    assert kind(templates.total_rows(df)) == "kpi"
    assert kind(templates.average_by(df, "city", "age")) == "bar"
    assert kind(df.select("signup", "age")) == "line"
    assert kind(df.select("age", "score")) == "scatter"
    assert kind(df.select("city")) == "bar"
    assert kind(df.limit(0)) is None
    assert kind(templates.count_by(df, "city"), "heatmap", source=df, types=people.types) == "heatmap"
    assert kind(templates.count_by(df, "city"), "violin", x="city", y="age", source=df, types=people.types) == "violin"
    assert kind(df.select("city"), "scatter") is None
    bars = charts.category_bar(df, "city", "age").collect()
    assert [r["city"] for r in bars] == ["Pune", "Mumbai", "Delhi"] or bars[0]["age"] >= bars[-1]["age"]


def test_result_summaries(people):
    df = people.df
    rows = findings.summarize_result(templates.average_by(df, "city", "age")).collect()
    assert [r["kind"] for r in rows] == ["highest", "lowest"]
    assert findings.summarize_result(df.limit(0)).first()["kind"] == "empty"
    assert findings.summarize_result(templates.total_rows(df)).first()["value"] == 11.0
    assert findings.summarize_result(df.select("city")).first()["label"] == "Mumbai"


def test_findings(people):
    kinds = {r["type"] for r in findings.statistical_findings(people, 55.0).collect()}
    assert kinds == {"dataset_summary", "missing_values", "numeric_summary", "skewness", "category_distribution", "correlation", "quality"}


@pytest.mark.parametrize("limit", [100, 0])
def test_crosstabs_match_brute_force(spark, monkeypatch, limit):
    """Pairs counted by a dictionary and row by row: missing values, a hot pair, more tasks than values."""
    monkeypatch.setattr(eda, "DICTIONARY_VALUES", limit)
    rows = [("x" if i % 4 else None, f"c{i % 7}", "hot" if i % 9 else "rare", str(i % 2) if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "a string, `b.c` string, d string, e string").repartition(6)
    names = df.columns
    got = {tuple(r) for r in eda.crosstabs(eda.Table(df, dict.fromkeys(names, "Categorical")), columns=names).collect()}
    want: dict = {}
    for row in rows:
        for i, j in itertools.combinations(range(4), 2):
            if row[i] is not None and row[j] is not None:
                key = (names[i], names[j], row[i], row[j])
                want[key] = want.get(key, 0) + 1
    assert got == {(*k, n) for k, n in want.items()}
