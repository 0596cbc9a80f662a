"""Cases of the fourth review: pairs just below the threshold, code of joins that the JVM compiles."""

import random
import re

import numpy as np
import pytest

from assayer.llm import near_dup
from tests.llm.test_advice_r03 import sharing
from tests.llm.test_table_operators import brute_groups


def test_parities_differ_in_no_more_places_than_the_sets():
    draw = np.random.default_rng(4)
    for size in (1, 5, 400, 30_000):
        both, ours, theirs = (draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for n in (size, size // 7, size // 5))
        a, b = (near_dup.parities(np.unique(np.concatenate([both, own]))) for own in (ours, theirs))
        differs = sum(int(x).bit_count() for x in (a ^ b).view(np.uint64))
        assert differs <= len(ours) + len(theirs)
        assert size > 400 or differs >= 0.85 * (len(ours) + len(theirs))


def below(n):
    """Texts of one passage with words changed here and there, most pairs of which lie just below the threshold of 0.85."""
    draw, passage = random.Random(3), [f"p{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = list(passage)
        for at in draw.sample(range(0, 400, 8), 7):
            words[at] = f"w{draw.randrange(10**9)}"
        rows.append((len(rows), words))
        if i % 12 == 0:
            rows.append((len(rows), [*words[:-1], "changed"]))
    return [(i, " ".join(w)) for i, w in rows]


@pytest.mark.parametrize("crowded", [4, 1000])
def test_pairs_just_below_the_threshold_are_not_held_against_full_sets(spark, monkeypatch, crowded):
    monkeypatch.setattr(near_dup, "CROWDED", crowded)
    tried, confirmed = [], near_dup._confirmed

    def counted(pairs, *args):
        tried.append(pairs.count())
        return confirmed(pairs, *args)

    monkeypatch.setattr(near_dup, "_confirmed", counted)
    rows = below(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, 3, 0.85).collect()}
    assert got == brute_groups(rows, 3, 85)
    assert sum(tried) <= 6 * len(rows), tried


def test_joins_that_estimate_are_compiled(spark, monkeypatch, capsys):
    monkeypatch.setattr(near_dup, "CROWDED", 4)
    sizes, across = [], near_dup._across

    def measured(*args):
        pairs = across(*args)
        capsys.readouterr()
        pairs.explain("codegen")
        sizes.extend(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)))
        return pairs

    monkeypatch.setattr(near_dup, "_across", measured)
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        near_dup.near_duplicates(spark.createDataFrame(sharing(150, 60, 30), "doc_id long, text string"), 3, 0.85).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sizes and max(sizes) < 8000, sizes
