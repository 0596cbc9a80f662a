import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import bpe, decontamination, langid, pseudonyms, quality_rules, textarrays
from tests.llm.conftest import ODD_TEXTS, prose

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
VOCABULARY = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(VOCABULARY, "rb") as f:
        return tokenizers.Tokenizer.from_file(VOCABULARY), bpe.codec(f.read())


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from("abcdehlmnrstv '\n\t.,1٣é　🙂"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bpe_matches_the_library(both, text):
    library, own = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_special_tokens_endings_and_long_runs(both):
    library, own = both
    for text in ("<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "don't I'll 'tis ''s x'rex we're'd", "a" * 5000, " " * 999 + "x", "'", "x'l"):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_decodes_broken_bytes_as_the_library(both):
    library, own = both
    ids = random.Random(5).choices(range(50257), k=400)
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark, odd_docs, no_docs, both):
    got = bpe.encode_decode(odd_docs, VOCABULARY).collect()
    assert sorted(map(str, (r.decoded for r in got))) == sorted([t or "" for t in ODD_TEXTS] + [ODD_TEXTS[6]] * 2)
    assert all(r.ids == both[0].encode(r.decoded, add_special_tokens=False).ids for r in got)
    assert bpe.encode_decode(no_docs, VOCABULARY).count() == 0


def brute_counts(text):
    words = textarrays_words(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if textarrays_words(x)]
    return [len(words), sum(map(len, words)), sum(text.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)]


def textarrays_words(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab #|é\n\t\x0b日"), max_size=40), min_size=1, max_size=6))
def test_text_counts(texts):
    got = np.stack(quality_rules.text_counts(texts), axis=1).tolist()
    assert got == [brute_counts(t) for t in texts]


def test_slices_keep_long_texts_whole():
    import pyarrow as pa

    column = pa.array(["x" * 10, "y" * 3_000_000, None, "z"])
    cuts = list(textarrays.slices(column, 1000))
    assert cuts[0][0] == 0 and cuts[-1][1] == 4 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))


def test_pseudonyms_are_reversible_linked_and_keep_format():
    own, other = pseudonyms.Pseudonymiser(b"one"), pseudonyms.Pseudonymiser(b"two")
    values = {
        "mail": "ab.12@mail.example.com", "secret": "password=e1c093f22d3955eaac", "iban": "GB82 WEST 1234 5698 7654 32", "address": "227.5.221.1",
        "date": "2024-02-29", "card": "4111 1111 1111 1111", "social": "123-45-6789", "phone": "+1 (743) 555-3824",
    }
    for kind, value in values.items():
        changed = own.value(kind, value)
        assert changed != value and len(changed) == len(value) or kind == "address"
        assert own.value(kind, changed, back=True) == value
        assert other.value(kind, value) != changed
        text, n = own.text(f"see {value} and {value}.")
        assert n == 2 and text == f"see {changed} and {changed}."


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 300))
def test_feistel_is_a_permutation(size):
    network = pseudonyms.Permuter(b"k")
    image = [network.permute("t", size, v) for v in range(size)]
    assert sorted(image) == list(range(size))
    assert [network.permute("t", size, v, back=True) for v in image] == list(range(size))


def test_invalid_numbers_stay():
    for text in ("4111 1111 1111 1112", "2023-02-30", "300.1.1.1", "GB83 WEST 1234 5698 7654 32", "plain text of 12 words"):
        assert pseudonyms.Pseudonymiser(b"k").text(text) == (text, 0)


def test_pseudonym_rows(odd_docs, no_docs):
    got = pseudonyms.pseudonymise(odd_docs, b"k", count_col="n")
    assert got.columns == [*odd_docs.columns, "n"]
    assert sorted(str(r.text) for r in got.select("text").collect()) == sorted(map(str, [*ODD_TEXTS, ODD_TEXTS[6], ODD_TEXTS[6]]))
    assert pseudonyms.pseudonymise(no_docs, b"k").count() == 0


def test_overlaps_survive_substitutions(spark, odd_docs, no_docs):
    passage = prose(40, 9).split()
    changed = [("x" if i % 7 == 3 else w) for i, w in enumerate(passage)]
    docs = spark.createDataFrame(
        [(1, prose(50, 4) + " " + " ".join(passage)), (2, " ".join(changed).upper()), (3, prose(300, 5)), (4, None), (5, ""), (6, " ".join(passage[:8])), (1, prose(3, 4))],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(7, " ".join(passage)), (7, " ".join(passage)), (8, None), (9, ""), (10, "a b")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.doc_start, r.n_agree) for r in decontamination.find_overlaps(docs, items).collect()}
    assert {g[:2] for g in got} == {(1, 7), (2, 7)}
    assert (1, 7, 50, 40) in got
    blocks = {tuple(r) for r in decontamination.find_overlaps(docs, items, max_seeds=10).collect()}
    assert {(b[0], b[1], b[2], b[5]) for b in blocks} == got
    assert {r.doc_id for r in decontamination.decontaminate(docs, items).collect()} == {1, 3, 4, 5, 6}
    assert decontamination.decontaminate(odd_docs, items).columns == odd_docs.columns
    assert decontamination.decontaminate(odd_docs, items).count() == odd_docs.count()
    assert decontamination.find_overlaps(no_docs, items).count() == 0
    assert decontamination.find_overlaps(docs, no_docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_language_identification(spark, odd_docs, no_docs):
    def text(alphabet, seed):
        draw = random.Random(seed)
        return " ".join("".join(draw.choices(alphabet, k=draw.randint(2, 7))) for _ in range(30))

    alphabets = {"aa": "abcdeo", "bb": "oxyzkq", "cc": "aéèoçu"}
    rows = [(i * 3 + j, text(a, i * 3 + j), lang) for i in range(80) for j, (lang, a) in enumerate(alphabets.items())]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34", "bb"), (902, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs.filter("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    wrong = [i for i, _, lang in rows if got[i].lang_pred != lang]
    assert len(wrong) <= 2
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[901].score == 0 and got[900].rejected
    assert all(0 <= r.score <= 1 for r in got.values()) and got[902].lang_pred in alphabets
    odd = langid.predict(odd_docs, model, keep=("doc_id", "kept")).collect()
    assert len(odd) == odd_docs.count() and sum(r.lang_pred == "und" for r in odd) == 3
    assert langid.fit(no_docs) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(no_docs, model).count() == 0
