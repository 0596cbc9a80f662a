import pytest

from assayer.operators import cleaning
from tests.test_assessment import TYPES


def test_clean_messy(messy):
    got = cleaning.clean(messy, TYPES, ["row_id"])
    rows = {r["row_id"]: r for r in got.df.collect()}
    assert sorted(rows) == list(range(1, 12))                 # row 12 repeats row 11
    assert rows[4]["age"] == rows[3]["age"] == 29.0           # -4 became missing; median of the nine valid values
    assert rows[8]["age"] == 150.0                            # outliers stay
    assert rows[5]["city"] == "Delhi" and rows[1]["city"] == "delhi"
    assert rows[8]["joined_date"] is None and rows[9]["joined_date"] is None
    assert rows[3]["review"] is None and rows[2]["review"] == "late"
    assert rows[1]["is_active"] is True and rows[2]["is_active"] is False
    s = got.summary.first()
    assert (s["original_rows"], s["final_rows"], s["duplicate_rows_removed"]) == (12, 11, 1)
    assert (s["normalized_null_like_values"], s["invalid_values_converted_to_missing"]) == (1, 1)
    assert (s["missing_before_imputation"], s["missing_values_filled"], s["remaining_missing_values"]) == (6, 3, 3)
    log = {(r["column"], r["operation"]): r["count"] for r in got.log.collect()}
    assert log["joined_date", "invalid_datetime"] == 1 and log["age", "numeric_imputation"] == 2
    assert log["review", "missing_preserved"] == 1


@pytest.mark.parametrize("facts,want", [
    ({"valid": 1, "min": 4.0, "max": 4.0, "skew": None, "mean": 4.0, "median": 4.0}, ("single_value", 4.0)),
    ({"valid": 8, "min": 4.0, "max": 4.0, "skew": 0.0, "mean": 4.0, "median": 4.0}, ("constant", 4.0)),
    ({"valid": 50, "min": 0.0, "max": 9.0, "skew": -0.76, "mean": 4.0, "median": 5.0}, ("median", 5.0)),
    ({"valid": 9, "min": 0.0, "max": 9.0, "skew": 0.1, "mean": 4.0, "median": 5.0}, ("median", 5.0)),
    ({"valid": 10, "min": 0.0, "max": 9.0, "skew": 0.75, "mean": 4.0, "median": 5.0}, ("mean", 4.0)),
])
def test_numeric_fill(facts, want):
    assert cleaning.choose_numeric_fill(facts) == want


@pytest.mark.parametrize("facts,want", [
    ({"rows": 10, "missing": 10, "valid": 0, "unique": 0, "top": 0, "mode": None}, "Unknown"),
    ({"rows": 120, "missing": 10, "valid": 110, "unique": 60, "top": 50, "mode": "a"}, "Unknown"),
    ({"rows": 10, "missing": 4, "valid": 6, "unique": 1, "top": 6, "mode": "a"}, "Unknown"),
    ({"rows": 12, "missing": 2, "valid": 10, "unique": 3, "top": 4, "mode": "a"}, "a"),
    ({"rows": 12, "missing": 2, "valid": 10, "unique": 4, "top": 3, "mode": "a"}, "Unknown"),
])
def test_category_fill(facts, want):
    assert cleaning.choose_category_fill(facts)[1] == want


def test_boolean_fill_and_kept_columns(spark):
    rows = [(True if i < 8 else False if i < 19 else None, None if i < 13 else float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "b boolean, x double")
    facts = cleaning.fill_facts(df, {"b": "Boolean", "x": "Numerical"})
    fills = cleaning.choose_fills(facts, {"b": "Boolean", "x": "Numerical"})
    assert fills == {"b": ("keep", None), "x": ("keep", None)}   # no dominant value; 65 % missing
    strong = spark.createDataFrame([(True,)] * 17 + [(False,)] * 2 + [(None,)], "b boolean")
    facts = cleaning.fill_facts(strong, {"b": "Boolean"})
    assert cleaning.choose_fills(facts, {"b": "Boolean"}) == {"b": ("mode", True)}


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("$1,200",), ("7",)], "amount string")
    assert [r[0] for r in cleaning.clean(df, {"amount": "Numerical"}).df.orderBy("amount").collect()] != [7.0, 1200.0]
    assert [r[0] for r in cleaning.clean(df, {"amount": "Numerical"}, lenient_numbers=True).df.orderBy("amount").collect()] == [7.0, 1200.0]


def test_no_schema_leaves_values(spark):
    df = spark.createDataFrame([(" a ", 1), ("n/a", 2)], "s string, n int")
    assert sorted(map(tuple, cleaning.clean(df).df.collect()), key=lambda r: r[1]) == [("a", 1), (None, 2)]


@pytest.mark.parametrize("key", [["row_id"], []])
def test_digest_first_duplicates_match_brute_force(spark, key):
    rows = [(i, "hot" if i % 3 else f"v{i % 40}", None if i % 2 else float(i % 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, name string, x double").repartition(5)
    if not key:
        df = df.drop("row_id")
    got = sorted(map(tuple, cleaning.drop_duplicates(df, key).collect()), key=str)
    best: dict = {}
    for i, name, x in rows:
        best.setdefault((name, x), i)
    want = [(i, *record) for record, i in best.items()] if key else list(best)
    assert got == sorted(want, key=str)


def test_single_rows_pass_without_a_shuffle(spark):
    df = spark.range(1000).selectExpr("id AS row_id", "id % 990 AS x", "CAST(id % 990 AS STRING) AS name")
    plan = cleaning.drop_duplicates(df, ["row_id"])._jdf.queryExecution().executedPlan().toString()
    single = plan.split("Union")[1]
    assert "BroadcastHashJoin" in single.split("LeftSemi")[0]


def test_both_versions_are_counted_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a"), (2, " a "), (3, "n/a"), (4, None), (5, "n/a")], "row_id long, name string")
    got = {(r.version, r.n) for r in cleaning.raw_and_normal_digests(df, ["row_id"]).where("n > 1").collect()}
    assert got == {(0, 2), (1, 2), (1, 3)}
