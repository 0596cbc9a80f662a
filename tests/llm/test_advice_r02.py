"""Cases of the second review: each failed before its finding was settled."""

import random
import re

import numpy as np
import pytest

from assayer.llm import near_dup, pseudonyms, quality_classifier, quality_rules


def varied(seed, words=160, vocabulary=4000):
    """A text of made-up words, drawn with a long tail, so that texts share common words and differ in rare ones."""
    letters, draw = random.Random(1), random.Random(seed)
    known = ["".join(letters.choices("etaoinshrdlucm", k=letters.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(known[min(int(draw.paretovariate(0.6)), vocabulary) - 1] for _ in range(words))


@pytest.mark.parametrize("copies", [1, 60])
def test_classifier_keeps_clean_unseen_text(spark, copies):
    trusted = [(i, varied(i), "fr") for i in range(40)] + [(0, varied(0), "fr")] * (copies - 1)
    unseen = [(100 + i, varied(100 + i), "fr") for i in range(60)]
    bad = [(200 + i, " ".join(f"{w}%|" for w in varied(200 + i).split()), "fr") for i in range(5)]
    docs = spark.createDataFrame([*trusted, *unseen, *bad], "doc_id long, text string, lang string")
    rows = quality_classifier.classify(docs, docs.filter("doc_id < 40").select("doc_id")).collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert len(rows) == docs.count() and all(kept[i] for i in range(40))
    assert sum(kept[100 + i] for i in range(60)) >= 54 and not any(kept[200 + i] for i in range(5))


@pytest.mark.parametrize(("total", "common", "threshold"), [(7, 6, 0.85), (14, 12, 0.85), (5, 4, 0.8), (10, 8, 0.8)])
def test_estimates_keep_small_sets_at_the_threshold(total, common, threshold):
    factors, masks = near_dup.permutations(near_dup.SKETCH)
    draw, lost = np.random.default_rng(total), 0
    for _ in range(500):
        union = draw.integers(0, 1 << 63, total, dtype=np.uint64) * np.uint64(2) + draw.integers(0, 2, total, dtype=np.uint64)
        half = common + (total - common) // 2
        a, b = union[:half], np.concatenate([union[:common], union[half:]])
        differs = np.zeros(near_dup.SKETCH // 64, np.int64)
        for x, y in zip(*(near_dup.pack(near_dup.places(s, factors, masks)).reshape(near_dup.LOW_BITS, -1) for s in (a, b)), strict=True):
            differs |= x ^ y
        agree = 1 - sum(int(d).bit_count() for d in differs.view(np.uint64)) / near_dup.SKETCH
        chance = 0.5**near_dup.LOW_BITS
        lost += (agree - chance) / (1 - chance) < near_dup.estimate_floor(threshold)
    assert lost == 0


NUMBERS = {
    "card": "4111111111111111", "spaced": "4111 1111 1111 1111", "phone": "415-555-0123", "blanks": "415 555 0123", "date": "2020-01-02", "social": "123-45-6789",
    "iban": "GB82 WEST 1234 5698 7654 32", "address": "10.20.30.40",
}


@pytest.mark.parametrize(("text", "values"), [
    ("12 4111111111111111", ["card"]), ("5 4111111111111111", ["card"]), ("4111 1111 1111 1111 123", ["spaced"]), ("415-555-0123 2020-01-02", ["phone", "date"]),
    ("123-45-6789 2020-01-02", ["social", "date"]), ("415-555-0123 415-555-0124", ["phone"]), ("415 555 0123 415 555 0124", ["blanks"]),
    ("2023-02-30 415-555-0123", ["phone"]), ("GB82 WEST 1234 5698 7654 32 THEN 4111111111111111", ["iban", "card"]), ("10.20.30.40 2020-01-02 7", ["address", "date"]),
])
def test_numbers_next_to_each_other_are_all_found(text, values):
    own = pseudonyms.Pseudonymiser(b"k")
    got, n = own.text(text)
    assert n >= len(values) and len(got) >= len(text) - 12
    for name in values:
        kind = {"spaced": "card", "blanks": "phone"}.get(name, name)
        assert NUMBERS[name] not in got and own.value(kind, NUMBERS[name]) in got
    assert "0124" not in got


def brute_worth(own, text):
    """The most that readings of a text can be worth: all spans, each matched in the whole text."""
    found, failed = {}, []
    for kind, pattern in pseudonyms.PATTERNS:
        for s in range(len(text)):
            formed = [e for e in range(s + 1, len(text) + 1) if _spans(pattern, text, s, e)]
            valid = [e for e in formed if own.value(kind, text[s:e]) is not None]
            usual = [e for e in formed if kind == "iban" or (kind == "card" and pseudonyms.USUAL_CARD.fullmatch(text[s:e]))]
            failed += [(s, max(usual))] if usual and not valid else []
            found.setdefault(s, []).extend((e, kind) for e in valid)
    best = [(0, 0, 0, 0)] * (len(text) + 1)
    for s in range(len(text) - 1, -1, -1):
        options = [best[s + 1]]
        for e, kind in found.get(s, []):
            if kind != "phone" or not any(a <= s and e <= b for a, b in failed):
                options.append(tuple(map(int.__add__, own.worth(text, s, e, kind), best[e])))
        best[s] = max(options)
    return best[0]


def _spans(pattern, text, s, e):
    return re.match(f"(?s:.{{{s}}})(?:{pattern})(?s:.{{{len(text) - e}}})\\Z", text) is not None


def test_adjacent_numbers_match_brute_force():
    own, draw = pseudonyms.Pseudonymiser(b"k"), random.Random(4)
    pieces = [*NUMBERS.values(), "12", "5", "123", "2023-02-30", "4111 1111 1111 1112", "+1 415 555 0199", "(415) 555-0123", "AB", "x", "31.12.1999", "4222222222222"]
    for _ in range(5):
        text = "".join(p + draw.choice([" ", " ", "-", ", ", "."]) for p in draw.choices(pieces, k=draw.randint(2, 3)))
        spans = own.chosen(text, 0, len(text)) if pseudonyms.RUN.fullmatch(text) else None
        if spans is not None:
            got = [own.worth(text, s, e, kind) for s, e, kind, _ in spans]
            assert tuple(map(sum, zip((0, 0, 0, 0), *got, strict=True))) == brute_worth(own, text), text


@pytest.mark.parametrize("copies", [40, 300])
def test_copies_do_not_move_the_band(spark, copies):
    good = [(i, varied(i), "en") for i in range(60)]
    bad = [(100 + i, " ".join(f"{w}%|" if k % 3 == 0 else w for k, w in enumerate(varied(200 + i).split())), "en") for i in range(5)]
    few = [(300 + i, varied(300 + i), "fr") for i in range(3)]
    copied = [(1000 + i, good[0][1], "en") for i in range(copies)]
    docs = spark.createDataFrame([*good, *bad, *few, *copied], "doc_id long, text string, lang string").repartition(4)
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    alone = {r.doc_id: r.kept for r in quality_rules.judge(docs.filter("doc_id < 1000")).collect()}
    assert {i: k for i, k in kept.items() if i < 1000} == alone and len(kept) == docs.count()
    passing = np.flatnonzero(quality_rules._for_model([text for _, text, _ in good])).tolist()
    assert all(kept[i] == kept[0] for i in range(1000, 1000 + copies))
    assert all(kept[i] for i in passing) and len(passing) >= 40 and not any(kept[100 + i] for i in range(5)) and sum(kept[300 + i] for i in range(3)) == quality_rules._for_model([text for _, text, _ in few]).sum() > 0
