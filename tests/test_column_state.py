"""Mergeable column states: added part by part, they give the profile of the whole."""

import pytest
from pyspark.sql import functions as F

from assayer.operators import profile
from assayer.operators.column_state import ColumnStates


def comparable(found):
    return {r["column"]: {k: round(v, 6) if isinstance(v, float) else v for k, v in r.items() if k != "null_like_values"} | {
        "null_like_values": sorted(r["null_like_values"])} for r in found.records}


@pytest.fixture()
def orders(spark):
    return spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn(
        "note", F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN ' none ' WHEN 2 THEN '$1,200' ELSE '15' END")).withColumn(
        "placed", F.date_format("o_orderdate", "dd/MM/yyyy")).withColumn("empty", F.lit(None).cast("string"))


def test_states_give_the_profile_of_the_whole(spark, orders, tmp_path):
    states = ColumnStates(spark, str(tmp_path / "states"))
    assert states.add(orders, F.year("o_orderdate").cast("string")) > 3
    want, got = comparable(profile.schema_profile(orders)), comparable(states.profile())
    assert got.keys() == want.keys()
    for c, fields in want.items():
        assert {k: got[c].get(k) for k in fields} == fields, c


def test_old_files_are_not_read_again(spark, orders, tmp_path):
    folder = tmp_path / "table"
    old = orders.where("o_orderkey % 3 > 0").repartition(3)
    old.write.parquet(str(folder))
    first = sorted(str(f) for f in folder.glob("part-*.parquet"))
    read = lambda paths: spark.read.parquet(*paths)
    grown, whole = ColumnStates(spark, str(tmp_path / "grown")), ColumnStates(spark, str(tmp_path / "whole"))
    assert grown.add_files(first, read) == len(first)
    assert grown.add_files(first, read) == 0
    orders.where("o_orderkey % 3 = 0").repartition(2).write.mode("append").parquet(str(folder))
    files = sorted(str(f) for f in folder.glob("part-*.parquet"))
    assert whole.add_files(files, read) == len(files)
    seen = []
    assert grown.add_files(files, lambda paths: seen.extend(paths) or read(paths)) == len(files) - len(first)
    assert set(seen) == set(files) - set(first)
    assert comparable(grown.profile()) == comparable(whole.profile())


def test_messy_parts(spark, messy, tmp_path):
    states = ColumnStates(spark, str(tmp_path / "states"))
    for k in range(3):
        assert states.add(messy.where(F.col("row_id") % 3 == k), f"batch{k}", ["row_id"]) == 1
        assert states.add(messy.where(F.col("row_id") % 3 == k), f"batch{k}", ["row_id"]) == 0
    assert comparable(states.profile()) == comparable(profile.schema_profile(messy, ["row_id"]))
    assert states.parts() == {"batch0", "batch1", "batch2"}


def test_no_parts(spark, messy, tmp_path):
    states = ColumnStates(spark, str(tmp_path / "states"))
    assert states.add(messy.where("row_id < 0"), "none", ["row_id"]) == 0
    with pytest.raises(ValueError):
        states.profile()


def test_distinct_counts_widen_no_row(spark, orders):
    from assayer.operators import frames

    names = ["o_orderkey", "o_totalprice", "o_orderpriority", "empty"]
    want = orders.agg(*[F.count_distinct(c) for c in names]).first()
    assert list(frames.exact_distincts(orders, {c: F.col(c) for c in names}).values()) == list(want)
    zeros = spark.sql("SELECT CAST(x AS DOUBLE) AS x FROM VALUES ('0.0'), ('-0.0'), ('1') AS t(x)")
    assert frames.exact_distincts(zeros, {"x": F.col("x")}) == {"x": 2}
