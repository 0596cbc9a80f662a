import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import frames, quantiles, ranks

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def values_of(kind: str) -> list[float]:
    rng = random.Random(7)
    if kind == "spread":
        return [rng.uniform(-1e6, 1e6) for _ in range(5000)]
    if kind == "hot":  # one value holds more than a third of the rows
        return [42.0] * 2500 + [rng.gauss(40, 5) for _ in range(3000)]
    if kind == "heavy":
        return [rng.paretovariate(0.3) for _ in range(4000)] + [-1e300, 1e300]
    return [3.5]


@pytest.mark.parametrize("kind", ["spread", "hot", "heavy", "single"])
@pytest.mark.parametrize("way", ["builtin", "bracketed", "ranked"])
def test_column_quantiles(spark, monkeypatch, kind, way):
    data = values_of(kind)
    df = spark.createDataFrame([(v,) for v in data] + [(None,)], "x double")
    monkeypatch.setattr(quantiles, "SMALL_DISTINCT", 10**9 if way == "builtin" else 0)
    if way == "ranked":
        monkeypatch.setattr(quantiles, "BUFFER_LIMIT", 0)
    got = quantiles.column_quantiles(df, {"x": F.col("x")}, PROBS)["x"]
    assert np.allclose(got, np.quantile(data, PROBS), rtol=1e-9)


def test_grouped_quantiles(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.gauss(0, 1), float(rng.randint(0, 3)) if rng.random() > 0.2 else None) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    want = {(g, c): np.quantile([r[i] for r in rows if r[0] == g and r[i] is not None], [0.25, 0.5])
            for g in "ab" for i, c in ((1, "x"), (2, "y"))}
    for limit in (10**6, 1):
        monkeypatch.setattr(quantiles, "BUFFER_LIMIT", limit)
        got = {(r["g"], r["item"]): r["quantiles"] for r in quantiles.grouped_quantiles(df, ["g"], ["x", "y"], [0.25, 0.5]).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_ranks_of_many_groups_and_one_hot_one(spark, monkeypatch, broadcast):
    """One group holds most rows, one value most of that group; ranks run without a gap and follow the values."""
    monkeypatch.setattr(ranks, "MAX_BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    rows = [("hot", 7.0 if rng.random() < 0.6 else rng.gauss(7, 2)) for _ in range(3000)]
    rows += [(f"g{i}", float(j * i % 5)) for i in range(300) for j in range(1 + i % 4)]
    df = spark.createDataFrame(rows, "`g.x` string, v double").repartition(7)
    got: dict = {}
    for r in ranks.ranked(df, ["g.x"], ["v"]).collect():
        got.setdefault(r["g.x"], []).append((r["rank"], r["v"], r["size"]))
    want: dict = {}
    for g, v in rows:
        want.setdefault(g, []).append(v)
    assert got.keys() == want.keys()
    for g, placed in got.items():
        assert [(r, v) for r, v, _ in sorted(placed)] == list(enumerate(sorted(want[g]))) and {s for _, _, s in placed} == {len(want[g])}
    found = {r["g.x"]: r["quantiles"] for r in ranks.rank_quantiles(df, ["g.x"], "v", PROBS).collect()}
    assert found.keys() == want.keys() and all(np.allclose(found[g], np.quantile(want[g], PROBS)) for g in want)


def test_ranked_plan_has_no_window_over_rows(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS v")
    plan = ranks.rank_quantiles(df, ["g"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CollectLimit" not in plan


def test_no_rows_no_quantiles(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert ranks.rank_quantiles(df, ["g"], "v", [0.5]).count() == 0


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles.column_quantiles(df, {"x": F.col("x")}, [0.5]) == {"x": None}


@pytest.mark.parametrize("share", [1000, 4])
def test_matching_rows_with_hot_groups(spark, monkeypatch, share):
    """Against brute force: a hot value, a NULL-holding key, rare and single values."""
    monkeypatch.setattr(frames, "HOT_SHARE", share)
    keys = ["hot"] * 400 + [None] * 150 + [f"pair{i // 2}" for i in range(200)] + [f"one{i}" for i in range(250)]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k string")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for wanted, test in ((F.col("n") > 1, lambda n: n > 1), (F.col("n") <= 2, lambda n: n <= 2)):
        got = sorted(r["id"] for r in frames.matching_rows(rows, counts, ["k"], wanted, len(keys)).collect())
        assert got == [i for i, k in enumerate(keys) if test(keys.count(k))]
