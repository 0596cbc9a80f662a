"""Cases of the third review: words that collide under a polynomial modulo 2**64, crowded buckets, short and split items, clashing names."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import bpe, decontamination, entries, licenses, near_dup, quality_classifier, quality_rules, sharding, textarrays, word_classes
from tests.llm.conftest import prose
from tests.llm.test_table_operators import brute_groups

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
VOCABULARY = public.path("byte_bpe_50k.json")


def thue_morse(rounds, a="a", b="b"):
    """A word of 2**rounds letters and its complement."""
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


ONE, OTHER = thue_morse(11)


def test_words_that_collided_have_hashes_of_their_own():
    words = textarrays.spans(textarrays.Bytes.of([f"{ONE} {OTHER}", f"x {OTHER}"]), textarrays.SPACES)
    assert words.hash[0] != words.hash[1] == words.hash[3]


def test_collided_words_in_counts_sets_and_overlaps(spark):
    assert quality_rules.text_counts([f"{ONE}\n{OTHER}\n{ONE}"])[3].tolist() == [1]
    rows = [(1, f"a b {ONE}"), (2, f"a b {OTHER}"), (3, f"a b {ONE}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, 3, 0.85).collect()} == brute_groups(rows, 3, 85)
    items = spark.createDataFrame([(9, f"{ONE} a b c d e f g h")], "item_id long, text string")
    found = spark.createDataFrame([(1, f"{ONE} a b c d e f g h"), (2, f"{OTHER} a b c d e f g h")], "doc_id long, text string")
    assert {(r.doc_id, r.n_agree) for r in decontamination.find_overlaps(found, items, min_words=8).collect()} == {(1, 9), (2, 8)}


def test_collided_words_are_encoded_as_the_library_does(spark):
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    texts = [f"{ONE} {OTHER}", f"{OTHER} {ONE} {ONE}", ONE + OTHER]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_decode(docs, VOCABULARY).collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.decoded == texts[r.doc_id]


def test_encoder_compares_bytes_not_hashes(monkeypatch):
    with open(VOCABULARY, "rb") as f:
        own = bpe.Codec(f.read())
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    monkeypatch.setattr(textarrays, "span_hash", lambda data, low, high: (high - low).astype(np.uint64) % np.uint64(2))
    text = " ".join(random.Random(1).choices("the of and river stone light paper green 12 345 don't".split(), k=200))
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def sharing(n, shared, own):
    """Texts that share a passage and differ in the rest; one in twelve has a near copy."""
    draw, passage = random.Random(8), [f"p{i}" for i in range(shared)]
    rows = []
    for i in range(n):
        rows.append((len(rows), [*passage, *(f"w{draw.randrange(10**9)}" for _ in range(own))]))
        if i % 12 == 0:
            rows.append((len(rows), [*rows[-1][1][:-1], "changed"]))
    return [(i, " ".join(w)) for i, w in rows]


@pytest.mark.parametrize("crowded", [0, 4, 32])
def test_texts_that_share_a_passage_match_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(near_dup, "CROWDED", crowded)
    rows = sharing(150, 60, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, 3, 0.85).collect()}
    assert got == brute_groups(rows, 3, 85)


def test_pairs_of_a_shared_passage_grow_with_the_texts(spark, monkeypatch):
    made = []
    across = near_dup._across

    def counted(*args):
        pairs = across(*args)
        made[-1] += pairs.count()
        return pairs

    monkeypatch.setattr(near_dup, "_across", counted)
    monkeypatch.setattr(near_dup, "estimate_floor", lambda threshold: -1.0)  # all pairs that meet
    for n in (250, 500):
        made.append(0)
        docs = spark.createDataFrame(sharing(n, 100, 50), "doc_id long, text string").repartition(4)
        near_dup.near_duplicates(docs, 3, 0.85).count()
    assert made[1] <= 3 * max(made[0], 200), made


@pytest.mark.parametrize("max_seeds", [2_000_000, 3])
def test_short_items_and_parts_of_one_diagonal(spark, max_seeds):
    middle, item = prose(20, 3), prose(20, 1) + " " + prose(20, 2) + " " + prose(20, 4)
    parts = prose(20, 1) + " " + middle + " " + prose(20, 4)
    docs = spark.createDataFrame([(1, parts), (2, "x alpha beta y beta z"), (3, "Alpha, beta. gamma"), (4, "gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "alpha beta"), (9, "zeta"), (10, "alpha beta gamma"), (11, "gamma")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_words) for r in decontamination.find_overlaps(docs, items, max_seeds=max_seeds).collect())
    assert [g for g in got if g[0] > 1] == [(2, 8, 1, 0, 2), (3, 8, 0, 0, 2), (3, 10, 0, 0, 3), (3, 11, 2, 0, 1), (4, 11, 0, 0, 1)]
    ends = [(g[3], g[3] + g[4]) for g in got if g[0] == 1]
    assert len(ends) == 2 and ends[0][0] == 0 and ends[0][1] >= 20 and ends[1][0] <= 40 and ends[1][1] == 60
    assert {r.doc_id for r in decontamination.decontaminate(docs, items, max_seeds=max_seeds).collect()} == set()


def brute_overlaps(doc, item, masks, min_words):
    """Every pair of words whose masked windows agree, each diagonal cut into its best stretches by trying all."""
    d, w = doc.split(), item.split()
    lines = {i - j for m in masks for i in range(len(d) - len(m) + 1) for j in range(len(w) - len(m) + 1) if all(d[i + k] == w[j + k] for k, c in enumerate(m) if c == "1")}
    out = set()

    def cut(line, low, high):
        worth = [(sum(1 if d[j + line] == w[j] else -2 for j in range(a, b)), -a, -b) for a in range(low, high) for b in range(a + 1, high + 1)]
        if not worth or sum(d[j + line] == w[j] for j in range(low, high)) < min_words:
            return
        top = max(x[0] for x in worth)
        end = min(-b for s, _, b in worth if s == top)
        start = min(-a for s, a, b in worth if s == top and -b == end)
        if top <= 0:
            return
        n = sum(d[j + line] == w[j] for j in range(start, end))
        if n >= min_words:
            out.add((start + line, start, end - start, n))
        cut(line, low, start)
        cut(line, end, high)

    for line in lines:
        cut(line, max(0, -line), min(len(w), len(d) - line))
    return out


def test_overlaps_match_brute_force(spark):
    draw = random.Random(2)
    rows, items = [], []
    for i in range(12):
        item = [draw.choice("abcdefgh") + str(draw.randrange(3)) for _ in range(30)]
        items.append((i, " ".join(item)))
        text = [w if draw.random() < 0.85 else "x" for w in item]
        rows.append((i, " ".join(draw.choices("uvw", k=5) + text[: draw.randint(8, 30)] + ["y"] * draw.randint(0, 3) + text[draw.randint(0, 20) :])))
    got = {(r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_words, r.n_agree) for r in decontamination.find_overlaps(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), min_words=6).collect()}
    want = {(i, j, *o) for i, text in rows for j, item in items for o in brute_overlaps(text, item, decontamination.MASKS, 6)}
    assert got == want and want


def test_clashing_count_column(spark):
    docs = spark.createDataFrame([(1, "call 415-555-0123", 7)], "doc_id long, text string, n_replaced int")
    (row,) = entries.pseudonyms.pseudonymise(docs, b"k", count_col="n_replaced").collect()
    assert row.n_replaced == 1 and row.doc_id == 1


def test_only_ascii_letters_are_lowered(spark):
    docs = spark.createDataFrame([(1, "under the MİT license"), (2, "UNDER THE MIT LICENSE"), (3, "worK")], "doc_id long, text string")
    labels = {r.doc_id: r.base_labels for r in licenses.scan_licenses(docs).collect()}
    assert labels[2] == "mit" and not labels[1]
    words = docs.select(F.col("doc_id"), licenses._lower(F.col("text")).alias("w")).collect()
    assert words[2].w != "work"


def ordered(seed, words=200):
    """Sentences with a capital at the start, function words before nouns, a full stop or a comma here and there."""
    draw = random.Random(seed)
    noun = lambda: "".join(draw.choices("aeiourstnlmdp", k=draw.randint(4, 9)))
    out = []
    while len(out) < words:
        sentence = []
        for _ in range(draw.randint(2, 5)):
            sentence += [draw.choice(["the", "of", "and", "in"]), *(noun() for _ in range(draw.randint(1, 2)))]
            sentence[-1] += draw.choice(["", "", ","])
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1].rstrip(",") + "."]
    return " ".join(out[:words])


def mixed_up(text, seed):
    words = text.split()
    random.Random(seed).shuffle(words)
    return " ".join(words)


def test_shuffled_words_leave_the_band(spark):
    good = [(i, ordered(i, 150 + i), "en") for i in range(120)]
    bad = [(1000 + i, mixed_up(ordered(500 + i), i), "en") for i in range(40)]
    docs = spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string").repartition(3)
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert sum(kept[i] for i in range(120)) >= 116 and sum(kept[1000 + i] for i in range(40)) <= 4


def test_shuffled_words_exceed_the_trusted_limit(spark):
    good = [(i, ordered(i, 150 + i), "en") for i in range(160)]
    bad = [(1000 + i, mixed_up(ordered(500 + i), i), "en") for i in range(40)]
    docs = spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string").repartition(3)
    kept = {r.doc_id: r.kept for r in quality_classifier.classify(docs, docs.filter("doc_id < 100").select("doc_id")).collect()}
    assert sum(kept[i] for i in range(160)) >= 150 and sum(kept[1000 + i] for i in range(40)) <= 4


def test_word_classes_match_a_plain_reading():
    texts = ["The cat, of X. Ümlaut grün! ***", "", "a b", "don't (stop) now."]
    owner, value = word_classes.classes(texts)
    plain = [(i, w) for i, t in enumerate(texts) for w in t.split()]
    assert owner.tolist() == [i for i, _ in plain]
    for (_, w), c in zip(plain, value.tolist(), strict=True):
        core, ending = (w[:-1], 2 if w[-1] in ".!?" else 1) if w[-1] in ",;:.!?" else (w, 0)
        if not core[:1].isalpha():
            base = 0
        elif len(core) <= 3:
            base = word_classes.SHORT + 1 if core[0].isupper() else c % word_classes.BASES
        else:
            base = (word_classes.SHORT + 2 if core[0].isupper() else word_classes.SHORT + 5) + (len(core) > 5) + (len(core) > 8)
        assert c == ending * word_classes.BASES + base and 0 <= c < word_classes.CLASSES
    assert len(word_classes.class_grams(texts)[1]) == 7 - 2 + 1 and len(word_classes.class_grams([])[1]) == 0


def brute_shard(key, tree):
    """Three draws, each the child of the smallest -log(u) / weight, recomputed from the digests."""
    below, node = tree.children(), sharding.ROOT
    for _ in range(3):
        draws = [(-math.log((int(hashlib.md5(f"{key}|{n}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)) / w, n) for n, w in below[node].items()]
        node = min(draws)[1]
    return int(node)


def test_shards_match_recomputed_draws(spark):
    tree = sharding.Topology.regular(16).weighted(3, 2.5)
    docs = spark.createDataFrame([(i * 7919, f"text {i}") for i in range(400)] + [(None, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.place(docs, tree, tree.grown()).collect()}
    assert got == {i: (brute_shard("null" if i is None else i, tree), brute_shard("null" if i is None else i, tree.grown())) for i in got}
    assert len(set(got.values())) > 14


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def test_license_places_match_a_recount(spark):
    draw, parts = random.Random(6), "under the mit license apache version 2 cc by nc other Word é9".split()
    seps = [" ", "  ", "-", "\n", ". ", "/"]
    texts = ["".join(draw.choice(parts) + draw.choice(seps) for _ in range(draw.randint(0, 40))) for _ in range(60)]
    texts += [f"a {p.upper()} b {p} {p.replace(' ', '-')}" for p in PHRASES] + ["under the under the mit license", "cc by nc by nc", ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string").repartition(3)
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = "" if r.doc_id is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
