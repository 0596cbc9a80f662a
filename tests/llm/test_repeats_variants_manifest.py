"""Suffix-array dedup, spelling variants and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import entries, merkle, spelling, suffix_dedup, textarrays
from tests.llm.conftest import prose

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# --- repeated byte strings

def brute_repeats(rows, length):
    """{(doc_id, text): covered bytes} of distinct documents, in the order of their ids."""
    first, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode()) >> 9)):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in first:
                covered[i : i + length] = b"\1" * length
            first.add(raw[i : i + length])
        out[doc_id, text] = covered
    return out


def digests(raw, covered):
    runs = sum(bool(c) and (j == 0 or not covered[j - 1]) for j, c in enumerate(covered))
    return len(raw), sum(covered), runs, sha(bytes(b for b, c in zip(raw, covered, strict=True) if not c))


@pytest.mark.parametrize("seed", range(12))
def test_suffixes_and_common_prefixes_of_a_collection(seed):
    draw = random.Random(seed)
    alphabet = draw.choice(["ab", "abcd", "abcdefghijklmnopqrstuvwxyz"])
    strings = ["".join(draw.choices(alphabet, k=draw.randint(1, 40))).encode() for _ in range(draw.randint(1, 14))]
    strings += strings[:2]
    code, common, transform = suffix_dedup.sort_suffixes(strings, 100)
    every = sorted(((s[o:], i, o) for i, s in enumerate(strings) for o in range(len(s) + 1)), key=lambda x: [*x[0], x[1] - 1000])
    assert [(c >> 8, c & 255) for c in code.tolist()] == [x[1:] for x in every]
    shared = [next((n for n, (a, b) in enumerate(zip(x[0], y[0], strict=False)) if a != b), min(len(x[0]), len(y[0]))) for x, y in zip(every, every[1:], strict=False)]
    assert common.tolist() == [0, *shared]
    symbols = sorted({b for s in strings for b in s})
    assert transform.tolist() == [1 + symbols.index(strings[i][o - 1]) if o else 0 for _, i, o in every]


def passages(spark):
    """Shared passages with different surroundings, exact copies, periodic texts, long and short ones."""
    draw = random.Random(5)
    passage, short = prose(40, 70), prose(9, 71)
    rows = [(i, f"{prose(30, 100 + i)} {passage if i % 3 else short} {prose(20, 200 + i)}") for i in range(30)]
    rows += [(100 + i, rows[3][1]) for i in range(10)] + [(200, "ab" * 300), (201, "z" * 500), (202, "ab" * 55), (203, "é" * 200), (204, None), (205, ""), (206, "x" * 99)]
    rows += [(300, prose(5000, 9)), (301, " ".join(prose(5000, 9).split()[1000:1400]))]
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("sizes", [{}, {"batch": 8, "max_kinds": 3}, {"gram": 90}])
def test_repeats_match_brute_force(spark, sizes):
    rows, docs = passages(spark)
    want = brute_repeats(rows, 100)
    got = suffix_dedup.remove_repeats(docs, **sizes).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        removed = sum(x.high - x.low for x in r.spans)
        assert (len(raw), removed, len(r.spans), sha(bytes(r.kept))) == digests(raw, want[r.doc_id, texts[r.doc_id]])


def test_repeats_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute_repeats(rows, 100)
    got = Counter((r.doc_id, bytes(r.kept)) for r in suffix_dedup.remove_repeats(odd_docs).collect())
    assert got == Counter((i, bytes(b for b, c in zip((t or "").encode(), want[i, t], strict=True) if not c)) for i, t in rows)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_segments_hold_every_start_once(monkeypatch):
    texts = [prose(300, 1), "a" * 400, "", "short", prose(80, 2)]
    flat, ends = suffix_dedup._flat(texts)
    monkeypatch.setattr(suffix_dedup, "STEP", 333)
    start, count, _, _ = suffix_dedup.segments(flat.data, ends)
    starts = np.concatenate([np.arange(s, s + n) for s, n in zip(start, count, strict=True)])
    assert sorted(starts.tolist()) == [b + i for b, t in zip(flat.starts, texts, strict=False) for i in range(len(t.encode()) - 99)]


def test_long_stretches_hash_alike_wherever_they_stand(monkeypatch):
    draw = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    data = np.concatenate([draw, draw[500:2500], draw[500:2500]])
    start = np.array([500, 3000, 5000, 501])
    plain = textarrays.span_hash(data, start, start + 2000)
    monkeypatch.setattr(textarrays, "_EXACT", 64)
    assert (textarrays.span_hash(data, start, start + 2000) == plain).all() and len(set(plain.tolist())) == 2


# --- spelling variants

def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            n[word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near, form = defaultdict(set), {}
    for w in words:
        for i in range(len(w)):
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    listed = sorted(words)
    for a in listed:
        for b in listed:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
                near[a].add(b)
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best

    def last(w):
        return last(form[w]) if w in form else w

    return {(w, form.get(w), last(w), c, len(near[w]), words.get(form.get(w))) for w, c in words.items()}


def misspelt():
    draw, base = random.Random(3), ["mountain", "fountain", "mountains", "café-crème".replace("-", "é"), "xylophonist", "straße" + "nbahn", "aaaaaaaa", "Größenwahn"]
    words = base * 30
    for w in base * 3:
        at = draw.randrange(len(w))
        words += [draw.choice([w[:at] + w[at + 1 :], w[:at] + "q" + w[at:], w[:at] + "q" + w[at + 1 :]])] * draw.choice([1, 2, 2, 3])
    words += ["y" * 3000, "y" * 3001] * 2 + ["mountainz"] * 40 * 11
    draw.shuffle(words)
    rows = [(i if i % 7 else None, " ".join(words[i::40]).upper() if i % 2 else ", ".join(words[i::40])) for i in range(40)]
    return [*rows, (50, None), (51, ""), (52, "12 34")]


@pytest.mark.parametrize("region", [4, 4096])
def test_variants_match_brute_force(spark, region):
    rows = misspelt()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in spelling.variants(docs, region=region).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(rows)


def test_variants_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert {tuple(r) for r in spelling.variants(odd_docs).collect()} == brute_variants(rows)
    assert spelling.variants(no_docs).count() == 0


def test_tree_searches_find_all_that_is_close():
    draw = random.Random(7)
    words = sorted({"".join(draw.choices("abc", k=draw.randint(7, 9))) for _ in range(500)})
    own = spelling.Words.of(words)
    every = np.arange(len(words))
    a, b = spelling.near_pairs(own, every, np.zeros(len(words), np.int64))
    got = {frozenset((words[x], words[y])) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    x, y = (v.ravel() for v in np.meshgrid(every, every))
    fits = own.point[y, -1] - own.point[x, -1]
    x, y = x[(fits == 0) | (fits == 1)], y[(fits == 0) | (fits == 1)]
    good = spelling.one_edit(own, x, y)
    assert got == {frozenset((words[i], words[j])) for i, j in zip(x[good].tolist(), y[good].tolist(), strict=True)} and len(a) == len(got)


# --- Merkle manifest

def leaf_of(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def brute_tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, place in enumerate(at):
            run = nodes[place // 3 * 3 :][:3]
            paths[j].append(("".join(run[: place % 3]), "".join(run[place % 3 + 1 :])))
            at[j] = place // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
        trees[s] = brute_tree([leaf_of(r, r.text) for r in by[s]])
    root, tops = brute_tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for r, path in zip(by[s], trees[s][1], strict=True):
            text = r.text
            if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf_of(r, text)
            for left, right in path + top:
                folded = sha(left + folded + right)
            out.append((r.doc_id, leaf_of(r, r.text), trees[s][0], root, sha("".join(a + b for a, b in path + top)), folded, folded == root))
    return Counter(out)


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_manifest_matches_brute_force(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    docs = spark.createDataFrame(
        [(i, prose(3, i) + ("\n" if i % 3 else " ") + "end", "en", None if i % 11 == 0 else f"s{min(i % 10, 4)}", i) for i in range(95)] + [(500, "alone\n", None, "ü", None)],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).repartition(5)
    got = Counter(tuple(r) for r in merkle.proofs(docs).collect())
    assert got == brute_manifest(docs.collect()) and {r[-1] for r in got} == {True, False}


def test_manifest_odd_rows(spark, odd_docs, no_docs):
    got = Counter(tuple(r) for r in merkle.proofs(odd_docs).collect())
    assert got == brute_manifest(odd_docs.collect())
    assert merkle.proofs(no_docs).count() == 0
    one = odd_docs.limit(1)
    (row,) = merkle.proofs(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("")


@pytest.mark.parametrize("name", ["op11_column_bwt", "op12_spelling_variants", "op13_merkle_manifest"])
def test_queries_match_brute_force_on_whole_tables(spark, name):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = Counter(tuple(r) for r in entries.QUERIES[name](spark, SMALL).collect())
    if name.startswith("op11"):
        want = brute_repeats([(r.doc_id, r.text) for r in rows], 100)
        assert got == Counter((r.doc_id, *digests((r.text or "").encode(), want[r.doc_id, r.text])) for r in rows)
    elif name.startswith("op12"):
        assert got == Counter(brute_variants([(r.doc_id, r.text) for r in rows]))
    else:
        assert got == brute_manifest(rows)


def test_queries_name_their_columns(spark):
    sha_columns = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    assert entries.op13_merkle_manifest(spark, SMALL).columns == ["doc_id", *sha_columns, "verified"]
    assert entries.op11_column_bwt(spark, SMALL).select(F.col("n_bytes")).dtypes == [("n_bytes", "bigint")]
