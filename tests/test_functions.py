import datetime as dt

from pyspark.sql import functions as F, types as T

from assayer.functions import dates, naming, stats, text


def test_names():
    assert naming.normalize_name("  Order Date! ") == "order_date"
    assert all(map(naming.is_identifier_name, ("ID", "id_user", "user_id", "zip-code", "Sort Key", "row_uuid", "Invoice Number")))
    assert not any(map(naming.is_identifier_name, ("width", "number", "idle")))
    assert naming.has_date_name("Created") and naming.has_date_name("update_x") and not naming.has_date_name("price")
    assert naming.has_text_name("user_comments") and not naming.has_text_name("city")
    assert naming.negatives_are_suspicious("unit_price") and not naming.negatives_are_suspicious("price_change")


def test_number_parsing(spark):
    df = spark.createDataFrame([("12",), (" 1.5e3 ",), ("$1,200",), ("25%",), ("nan",), ("5f",), ("",), (None,), ("inf",), ("-.5",)], "s string")
    plain, lenient = (text.to_number(F.col("s"), T.StringType(), x) for x in (False, True))
    got = [tuple(r) for r in df.select(plain, lenient).collect()]
    inf = float("inf")
    assert got == [(12.0, 12.0), (1500.0, 1500.0), (None, 1200.0), (None, 25.0), (None, None), (None, None), (None, None),
                   (None, None), (inf, inf), (-0.5, -0.5)]


def test_missing_like(spark):
    df = spark.createDataFrame([(" N/A\t",), ("x",), (None,), ("--",), ("?",)], "s string")
    got = [r[0] for r in df.select(text.missing_like(F.col("s"), T.StringType(), ("n/a", "?"))).collect()]
    assert got == [True, False, True, False, True]


def test_date_parsing(spark):
    cases = {
        "2024-1-5": dt.datetime(2024, 1, 5), "2024/01/05": dt.datetime(2024, 1, 5), "31-12-2023": dt.datetime(2023, 12, 31),
        "12/31/2023": dt.datetime(2023, 12, 31), "2024-01-05T10:20:30": dt.datetime(2024, 1, 5, 10, 20, 30),
        "Mar 4 2024": dt.datetime(2024, 3, 4), "4 March 2024": dt.datetime(2024, 3, 4), "2024-02": dt.datetime(2024, 2, 1),
        "20240105": dt.datetime(2024, 1, 5), "2024-02-31": None, "45000": None, "9999999": None, "soon": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r[0]: r[1] for r in df.select("s", dates.parse_mixed(F.col("s"))).collect()}
    assert got == cases


def test_iso(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05' AS a, timestamp_ntz'2024-01-02 03:04:05.25' AS b")
    assert tuple(df.select(dates.iso(F.col("a")), dates.iso(F.col("b"))).first()) == (
        "2024-01-02T03:04:05", "2024-01-02T03:04:05.250000")


def test_moments_and_correlation(spark):
    import pandas as pd
    values = [1.0, 2.0, 2.5, 9.0, 4.0, 4.0]
    other = [2.0, 1.0, None, 7.0, 5.0, 3.0]
    df = spark.createDataFrame(list(zip(values, other)), "x double, y double").withColumn("k", F.lit(3.0))
    got = df.agg(stats.adjusted_skew(F.col("x")), stats.adjusted_kurtosis(F.col("x")), stats.adjusted_skew(F.col("k")),
                 stats.pearson(F.col("x"), F.col("y")), stats.pearson(F.col("x"), F.col("k"))).first()
    s, o = pd.Series(values), pd.Series(other)
    assert abs(got[0] - s.skew()) < 1e-9 and abs(got[1] - s.kurt()) < 1e-9 and got[2] == 0.0
    assert abs(got[3] - s.corr(o)) < 1e-12 and got[4] is None
