import math
import zlib
from collections import Counter, defaultdict

import pytest

from assayer.llm import licenses, near_dup, ngram_model, quality_classifier, quality_rules, sharding, storage, token_rollup
from tests.llm.conftest import ODD_TEXTS, prose


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]


def brute_groups(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = words_of(text)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def variants():
    """Copies and near copies of several texts, chains among them: each edits the one before."""
    rows = []
    for t in range(6):
        words = prose(80, 20 + t).split()
        for v in range(12):
            words = list(words)
            words[(v * 13 + t) % len(words)] = f"edit{t}_{v}"
            rows.append((len(rows) * 3, " ".join(words)))
        rows.append((len(rows) * 3, " ".join(words).upper()))
    return [*rows, (1000, ""), (1001, None), (1002, "one"), (1003, "ONE"), (1004, " \n"), (1005, prose(20_000, 8))]


@pytest.mark.parametrize(("width", "threshold"), [(3, 0.85), (5, 0.8)])
def test_near_duplicates_match_brute_force(spark, width, threshold):
    rows = variants()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, width, threshold).collect()}
    assert got == brute_groups(rows, width, round(100 * threshold))


def test_near_duplicate_edge_rows(odd_docs, no_docs):
    got = near_dup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    kept = near_dup.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = Counter(r.text for r in kept.select("text").collect())
    assert texts[ODD_TEXTS[6]] == 1 and texts[ODD_TEXTS[7]] + texts[ODD_TEXTS[8]] == 1 and texts[None] == 1
    assert near_dup.near_duplicates(no_docs).count() == 0 and near_dup.deduplicate(no_docs).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in near_dup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_signature_estimate_is_unbiased():
    import numpy as np

    factors, masks = near_dup.permutations(near_dup.SKETCH)
    pool = near_dup.shingle_sets([prose(4000, 50)], 3)[0]
    a, b = pool[:900], pool[100:1000]
    low = [near_dup.minima(s, factors, masks) & np.uint64(3) for s in (a, b)]
    agree = float((low[0] == low[1]).mean())
    assert abs((agree - 0.25) / 0.75 - 0.8) < 0.07
    assert 0.85**4 > 0.5 and near_dup.bands_for(0.85) == math.ceil(math.log(1e-7) / math.log(1 - 0.85**4))


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney over bytes, from the definition."""
    levels = {order: Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discounts(level):
        n = Counter(level.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        found = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] and y is not None else 0 for i in (1, 2, 3)]
        return [d if 0 < d <= i else i / 2 for i, d in enumerate(found, 1)]

    tables = {}
    for k, level in levels.items():
        d, total, freed = discounts(level), Counter(), Counter()
        for g, c in level.items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3) - 1]
        tables[k] = (level, d, total, freed)

    def p(gram):
        if not gram:
            return 1 / 256
        level, d, total, freed = tables[len(gram)]
        c, h = level.get(gram, 0), gram[:-1]
        if not total[h]:
            return p(gram[1:])
        return max(c - d[min(c, 3) - 1], 0) / total[h] * (c > 0) + freed[h] / total[h] * p(gram[1:])

    return p


@pytest.mark.parametrize("max_entries", [10**6, 400])
def test_perplexity_matches_the_definition(spark, max_entries):
    train = [prose(60, s) for s in range(6)]
    test = [prose(40, 77), train[0], "completely other Ünicode text, 12345", "abc", "", None]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(train)], "doc_id long, text string, lang string")
    model = ngram_model.estimate(ngram_model.count_grams(docs))
    rows = [(i, t, "en") for i, t in enumerate(test)] + [(50, test[0], "xx"), (51, test[0], None), (0, test[0], "en")]
    scored = ngram_model.score(spark.createDataFrame(rows, docs.schema), model, ["doc_id", "lang"], max_entries=max_entries).collect()
    assert len(scored) == len(rows)
    p = brute_model([t.encode() for t in train], ngram_model.ORDER)
    for r in scored:
        text = (test[r.doc_id] if r.doc_id < 50 else test[0]) or ""
        grams = [text.encode()[i : i + 5] for i in range(len(text.encode()) - 4)] if r.lang == "en" else []
        if not grams:
            assert r.perplexity is None
        else:
            expected = math.exp(-sum(math.log(p(g)) for g in grams) / len(grams))
            assert r.perplexity == pytest.approx(expected, rel=1e-3)


def test_rules_and_classifier_reject_what_differs(spark, odd_docs, no_docs):
    good = [(i, prose(150 + i, i), "en") for i in range(60)]
    bad = [(100 + i, " ".join(f"{w}%%%|" for w in prose(150, 200 + i).split()), "en") for i in range(4)]
    docs = spark.createDataFrame([*good, *bad, (200, prose(20, 3), "en"), (201, "again and again " * 60, "en"), (202, None, None)], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert all(kept[i] for i, _, _ in good) and not any(kept[i] for i in (*range(100, 104), 200, 201, 202))
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == {i for i, _, _ in good}
    trusted = docs.filter("doc_id < 60").select("doc_id")
    classed = {r.doc_id: r.kept for r in quality_classifier.classify(docs, trusted).collect()}
    assert all(classed[i] for i, _, _ in good) and not any(classed[i] for i in (*range(100, 104), 202))
    assert quality_rules.judge(odd_docs).count() == odd_docs.count() == quality_classifier.classify(odd_docs, trusted).count()
    assert quality_rules.keep_good(odd_docs).columns == odd_docs.columns
    assert quality_rules.judge(no_docs).count() == 0 and quality_classifier.classify(no_docs, trusted).count() == 0
    assert all(r.kept for r in quality_classifier.classify(docs, trusted.limit(0)).filter("doc_id < 202").collect())


def test_shards_move_only_into_the_new_one(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, prose(i % 9, i)) for i in range(2000)], "doc_id long, text string").repartition(3)
    tree = sharding.Topology.regular(16)
    rows = sharding.place(docs, tree, tree.grown()).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and sum(r.grown_shard == 16 for r in rows) == pytest.approx(2000 / 17, rel=0.4)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.text_crc32 == zlib.crc32(prose(r.doc_id % 9, r.doc_id).encode()) and r.size == len(prose(r.doc_id % 9, r.doc_id).encode()) + 1
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    heavy = {r.doc_id: r.shard for r in sharding.place(docs, tree.weighted(5, 3.0)).collect()}
    before = {r.doc_id: r.shard for r in rows}
    assert all(heavy[i] == s or heavy[i] in range(8) for i, s in before.items())  # only into the region whose weight grew
    assert all(heavy[i] == s for i, s in before.items() if heavy[i] not in range(8))
    odd = sharding.place(odd_docs, tree).collect()
    assert len(odd) == odd_docs.count() and len({(r.shard, r.slot) for r in odd}) == len(odd)
    assert sharding.place(no_docs, tree).count() == 0


def test_license_labels(spark, odd_docs, no_docs):
    notice = licenses.TEMPLATES[1][1]
    broken = notice.replace("obtaining a copy", "who has got one copy").upper()
    docs = spark.createDataFrame(
        [
            (1, "Released under the MIT License. Then: under-the-MIT-license"), (2, f"{prose(30)}\n{notice}"), (3, f"* {broken}"), (4, "licensed cc by nc"),
            (5, notice[:60]), (6, None), (7, ""), (8, "Licensed under the Apache License, Version 2.0."), (8, "Licensed under the Apache License, Version 2.0."),
        ],
        "doc_id long, text string",
    )
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[1].labels, got[1].n_base, got[1].first_word, got[1].last_word) == ("mit", 2, 1, 6)
    assert got[2].labels == got[3].labels == "mit" and got[2].base_labels == "" and got[2].score == 1 and 0.8 <= got[3].score < 1
    assert got[4].base_labels == got[4].labels == "cc-by-nc"
    assert got[5].labels == got[6].labels == got[7].labels == "" and got[6].n_words == 0 and got[7].first_word is None
    assert licenses.scan_licenses(docs).filter("doc_id = 8 AND labels = 'apache-2'").count() == 2
    assert licenses.scan_licenses(odd_docs).count() == odd_docs.count()
    assert licenses.scan_licenses(no_docs).count() == 0


def test_rollup_is_additive_and_idempotent(spark):
    schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
    rows = [("a", "en", "v1", 1, 10), ("a", "en", "v1", 1, 5), ("a", None, "v1", 1, None), ("b", "de", "v1", 1, 7), ("b", "de", "v1", 1, 7)]
    counts = spark.createDataFrame(rows, schema)
    store = token_rollup.TokenRollup(spark, storage.new_path(spark, "rollup-test"))
    assert store.totals().count() == 0
    assert store.apply("1", token_rollup.inserts(counts)) and not store.apply("1", token_rollup.inserts(counts))
    assert store.apply("x/y", token_rollup.deletes(counts.filter("source = 'b'").limit(1)))
    store.compact()
    store.compact()
    assert not store.apply("x/y", token_rollup.deletes(counts))
    new = spark.createDataFrame([("a", "en", "v2", 1, 4)], schema)
    assert store.apply("3", token_rollup.revisions(counts.filter("n_tokens = 5"), new))
    assert store.apply("empty", token_rollup.inserts(counts.limit(0)))
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert got == {("a", "en", "v1"): (1, 10), ("a", None, "v1"): (1, 0), ("b", "de", "v1"): (1, 7), ("a", "en", "v2"): (1, 4)}
    assert store.batches() == {"1", "x/y", "3", "empty"}
