"""Cases of the fourth review: quantiles of a few large groups without shuffling their rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import quantiles, ranks

PROBS = [0.0, 0.25, 0.5, 1.0]


def grouped(n):
    """A group of most rows, one of ties, a short one, one row alone and a group without values of y; x ends at infinity."""
    rng = random.Random(11)
    rows = [("large", rng.gauss(0, 1e6), float(rng.randint(0, 3)) if rng.random() > 0.2 else None) for _ in range(n)]
    rows += [("ties", 7.0 if rng.random() < 0.9 else rng.random(), 1.0) for _ in range(n // 5)]
    rows += [("short", float(i), -float(i)) for i in range(4)] + [("alone", 5.0, 2.0)]
    rows += [("none", rng.random(), None) for _ in range(6)] + [("ends", v, 0.0) for v in (1.0, 2.0, math.inf)]
    return rows


def expected(rows):
    out = {}
    for g in {r[0] for r in rows}:
        for i, c in ((1, "x"), (2, "y")):
            found = sorted(r[i] for r in rows if r[0] == g and r[i] is not None)
            at = [(len(found) - 1) * p for p in PROBS]
            if found:
                out[g, c] = [found[int(a)] if a == int(a) else (found[int(a)] + found[int(a) + 1]) / 2 if a % 1 == 0.5 else None for a in at]
                for k, a in enumerate(at):
                    if out[g, c][k] is None:
                        out[g, c][k] = found[int(a)] + (found[int(a) + 1] - found[int(a)]) * (a % 1)
    return out


def measured(spark, rows):
    df = spark.createDataFrame(rows, "`g.x` string, x double, y double").repartition(5)
    return {(r["g.x"], r["item"]): r["quantiles"] for r in quantiles.grouped_quantiles(df, ["g.x"], ["x", "y"], PROBS).collect()}


@pytest.mark.parametrize("small", [0, 5])  # all columns in brackets, or y by the percentile
def test_a_few_large_groups_are_not_ranked_by_a_sort(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL_DISTINCT", small)
    monkeypatch.setattr(quantiles, "BUFFER_LIMIT", 100)
    monkeypatch.setattr(ranks, "rank_quantiles", lambda *_: pytest.fail("all rows were sorted"))
    rows = grouped(50_000)
    got, want = measured(spark, rows), expected(rows)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)


def test_brackets_that_counts_disprove_are_ranked(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL_DISTINCT", 0)
    real = F.percentile_approx
    off = F.when(F.col("`g.x`") == "large", 1e6).otherwise(0.0)
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda v, ends, accuracy: F.transform(real(v, ends, accuracy), lambda e: e + F.max(off)))
    rows = grouped(25_000)
    got, want = measured(spark, rows), expected(rows)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)


def test_many_groups_have_no_sketch_each(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL_DISTINCT", 0)
    monkeypatch.setattr(quantiles, "SKETCHED_GROUPS", 3)
    monkeypatch.setattr(quantiles, "_bracketed", lambda *_: pytest.fail("a sketch for each of many groups"))
    rows = grouped(300)
    got, want = measured(spark, rows), expected(rows)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
