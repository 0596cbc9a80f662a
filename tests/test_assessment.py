"""Anomalies and quality of small tables, worked out by hand."""

import pytest

from assayer.operators import anomalies, quality
from assayer.operators.anomalies import AnomalyReport, Table

TYPES = {"member_id": "Identifier", "age": "Numerical", "city": "Categorical", "joined_date": "Datetime",
         "is_active": "Boolean", "review": "Text"}


@pytest.fixture(scope="module")
def table(messy):
    return Table(messy, TYPES, ["row_id"])


@pytest.fixture(scope="module")
def report(table):
    return AnomalyReport(table)


def rows_by(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_outliers(table):
    age = rows_by(anomalies.numeric_outliers(table))["age"]
    # Valid: -4 25 26 26 27 28 29 30 31 33 150, quartiles 26 and 30.5.
    assert (age["values_checked"], age["q1"], age["q3"], age["lower_bound"], age["upper_bound"]) == (11, 26.0, 30.5, 19.25, 37.25)
    assert (age["outliers"], age["extreme_outliers"], age["outlier_percentage"]) == (2, 2, 18.18)
    cells = anomalies.outlier_values(table).collect()
    assert sorted((r["row_id"], r["value"]) for r in cells) == [(4, -4.0), (8, 150.0)]


def test_zero_spread_has_no_outliers(spark):
    df = spark.createDataFrame([(5.0,)] * 9 + [(99.0,)], "x double")
    row = anomalies.numeric_outliers(df, {"x": "numeric"}).first()
    assert row["outliers"] == 0 and row["values_checked"] == 10 and row["upper_bound"] == 5.0


def test_too_few_values(spark):
    assert anomalies.numeric_outliers(spark.createDataFrame([(1.0,), (2.0,), (900.0,)], "x double"), {"x": "numeric"}).count() == 0


def test_sections(report):
    ids = report.identifiers.first()
    assert (ids["values_checked"], ids["missing_identifiers"], ids["duplicate_identifier_rows"]) == (12, 0, 2)
    dates = report.datetimes.first()
    assert (dates["values_checked"], dates["invalid_dates"], dates["invalid_percentage"]) == (11, 1, 9.09)
    assert (dates["minimum_date"], dates["maximum_date"]) == ("2024-01-05T00:00:00", "2024-11-15T00:00:00")
    dup = report.duplicates.first()
    assert (dup["duplicate_rows"], dup["duplicate_percentage"], dup["affected_rows"]) == (1, 8.33, 2)
    missing = rows_by(report.missingness)
    assert missing["review"]["missing_values"] == 1 and missing["city"]["severity"] == "low"
    assert missing["member_id"]["severity"] == "none"


def test_suspicious_rows(report):
    scores = {r["row_id"]: r["anomaly_score"] for r in report.suspicious_rows.collect()}
    # 4 and 8 are extreme outliers (2); 8 has a bad date too (+2); 11 and 12 share an id and are duplicates (2).
    assert scores == {4: 2, 8: 4, 11: 2, 12: 2}


def test_issues(report):
    kinds = {(r["type"], r["column"]) for r in report.issues.collect()}
    assert kinds == {("duplicate_rows", None), ("extreme_numeric_outliers", "age"), ("duplicate_identifiers", "member_id"),
                     ("invalid_dates", "joined_date")}
    summary = report.summary.first()
    assert (summary["high_severity_issues"], summary["medium_severity_issues"], summary["suspicious_rows"]) == (1, 3, 4)


def test_low_variance(spark):
    df = spark.createDataFrame([("k", "a" if i else "b", None, str(i)) for i in range(40)], "c string, n string, e string, u string")
    got = {r["column"]: (r["type"], r["unique_values"], r["dominant_percentage"]) for r in anomalies.low_variance(df).collect()}
    assert got == {"c": ("constant", 1, 100.0), "n": ("near_constant", 2, 97.5), "e": ("empty", 0, 0.0)}


def test_rare_values_against_brute_force(spark):
    values = ["hot"] * 600 + ["mid"] * 300 + ["r1"] * 5 + ["r2"] * 2 + ["six"] * 6 + [" N/A "] * 9
    df = spark.createDataFrame([(v,) for v in values], "c string")
    got = {r["value"]: r["n"] for r in anomalies.rare_categories(df, {"c": "category"}).collect()}
    assert got == {"r1": 5, "r2": 2}


def test_quality(table, report):
    q = quality.QualityReport(table, report)
    consistency = rows_by(q.consistency)
    assert consistency["city"]["inconsistent_values"] == 8      # delhi, Delhi x 7
    assert consistency["review"]["inconsistent_values"] == 1    # "  late "
    assert rows_by(q.validity)["joined_date"]["validity_score"] == 90.91
    scores = {r["component"]: r["score"] for r in q.components.collect()}
    assert scores["completeness"] == 94.44                       # 4 of 72 cells
    assert scores["uniqueness"] == round(0.6 * (100 - 8.33) + 0.4 * (100 - 100 * 2 / 12), 2)
    # 60 % of 18.18 % outliers, 25 at most for extremes, 30 % of a third of rows, no high-risk row.
    assert scores["anomaly_quality"] == round(100 - 18.18 * 0.6 - 25 - 10, 2)
    overall = q.overall.first()
    weights = {"completeness": .30, "uniqueness": .15, "validity": .20, "consistency": .15, "anomaly_quality": .20}
    assert overall["overall_score"] == round(sum(scores[k] * w for k, w in weights.items()), 2)
    assert q.priority_findings.first()["severity"] == "high"
    without = quality.QualityReport(table).components.collect()
    assert {r["component"]: r["score"] for r in without}["anomaly_quality"] == 100.0


def test_ratings(spark):
    df = spark.createDataFrame([(s,) for s in (95.0, 85.0, 75.0, 60.0, 40.0, 39.9)], "s double")
    assert [r[0] for r in df.select(quality.rating(df["s"])).collect()] == ["Excellent", "Very Good", "Good", "Fair", "Poor", "Critical"]


def test_missing_component_is_renormalised(spark):
    df = spark.createDataFrame([("completeness", 80.0), ("validity", None)], "component string, score double")
    assert quality.overall_score(df).first()["overall_score"] == 80.0
    assert quality.overall_score(df.where("score IS NULL")).first()["overall_score"] == 0.0


def test_empty_tables_are_refused(messy):
    for call in (anomalies.detect_anomalies, quality.analyze_quality):
        with pytest.raises(ValueError):
            call(messy.limit(0))
