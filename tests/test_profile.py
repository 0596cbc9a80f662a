import pytest

from assayer.operators import profile


def test_messy_types(messy):
    found = profile.schema_profile(messy, ["row_id"])
    assert found.types == {
        "member_id": "Identifier", "age": "Numerical", "city": "Categorical", "joined_date": "Datetime",
        "is_active": "Boolean", "review": "Text"}
    assert found.date_formats["joined_date"] == "%Y-%m-%d"
    by = {r["column"]: r for r in found.records}
    assert by["review"]["null_like_count"] == 1 and by["review"]["null_like_values"] == ["n/a"]
    assert by["joined_date"]["datetime_parse_ratio"] == round(10 / 11, 4)
    assert by["is_active"]["top_values"] == {"yes": 7, "no": 5}
    assert by["age"]["median"] == 28.0 and by["age"]["missing"] == 1
    assert found.to_df().count() == 6


@pytest.mark.parametrize("name,values,kind", [
    ("amount", ["$1,200", "₹500", "25%", "7"], "Numerical"),
    ("status", ["active", "inactive", "ACTIVE", "on"], "Boolean"),
    ("flag", ["yes", "yes", "yes"], "Categorical"),
    ("when", ["01/02/2024", "31/12/2023", "15/06/2024"], "Datetime"),
    ("tag", [f"AB-{i}" for i in range(40)], "Identifier"),
    ("blank", [None, None], "Empty"),
    ("body", ["a fairly long piece of prose that goes on and on, well past forty"] * 3, "Text"),
    ("notes", ["x", "y"], "Text"),
    ("mixed", [f"word{'s' * (i % 7)} {i % 29}" for i in range(60)], "Text"),
])
def test_cascade(spark, name, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"`{name}` string")
    assert profile.schema_profile(df).types == {name: kind}


def test_integer_columns(spark):
    df = spark.createDataFrame([(i, i, i % 2, 7 * i) for i in range(50)], "serial_key_no int, visits int, bit int, account_id int")
    assert profile.schema_profile(df).types == {
        "serial_key_no": "Identifier", "visits": "Numerical", "bit": "Boolean", "account_id": "Identifier"}


def test_day_first_format_wins(spark):
    df = spark.createDataFrame([("05/06/2024",), ("25/06/2024",)], "d string")
    assert profile.schema_profile(df).date_formats["d"] == "%d/%m/%Y"


def test_approximate_unique_keeps_decisions(messy):
    exact, approx = (profile.schema_profile(messy, ["row_id"], exact_unique=e) for e in (True, False))
    assert exact.types == approx.types


def test_aliases_and_guards(spark, messy):
    given = {"age": {"semantic_type": "FLOAT"}, "city": "category", "nowhere": "text"}
    assert profile.resolve_types(messy, given) == {"age": "Numerical", "city": "Categorical"}
    with pytest.raises(ValueError):
        profile.schema_profile(messy.limit(0))
    with pytest.raises(TypeError):
        profile.schema_profile(spark.sql("SELECT array(1) AS a"))
