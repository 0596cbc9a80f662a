"""What one pass over a table reads and generates."""

from unittest import mock

from pyspark.sql import functions as F

from assayer.operators import frames, profile
from assayer.operators.anomalies import Table


def test_only_category_columns_are_counted_for_categories(spark):
    table = Table(spark.createDataFrame([("x", 1.0), ("y", 2.0)], "c string, n double"), {"c": "Categorical", "n": "Numerical"})
    with mock.patch.object(frames, "approx_distincts", side_effect=frames.approx_distincts) as counted:
        assert table.approx_counts(["c"]) == table.approx_counts(["c"]) == {"c": 2}
    assert [list(c.args[1]) for c in counted.call_args_list] == [["c"]]


def test_text_columns_are_profiled_cell_by_cell(spark):
    texts = ["2024-01-05", "05/01/2024", "Jan 5 2024", "20240105", "2024-01-05T10:11:12Z", "2024", "ORD-17", "12345", "1,234", "", " ", None]
    df = spark.createDataFrame([(t, None, i) for i, t in enumerate(texts)], "a string, b string, c long")
    with mock.patch.object(profile.F, "approx_count_distinct", side_effect=F.approx_count_distinct) as sketches:
        rows = {r["column"]: r for r in profile.schema_profile(df).to_df().collect()}
    assert sketches.call_count == 2  # one for c, one for all text columns
    assert (rows["a"]["non_null"], rows["b"]["non_null"], rows["c"]["non_null"]) == (11, 0, 12)
