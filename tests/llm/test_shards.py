"""Models in small shards, several of them in one pass, and grams looked up once for all places."""

import math

import numpy as np
import pytest

from assayer.llm import ngram_model, quality_rules, textarrays
from tests.llm.conftest import prose
from tests.llm.test_table_operators import brute_model


def test_the_driver_holds_small_shards_and_one_pass_has_them_all(spark, monkeypatch):
    monkeypatch.setattr(ngram_model, "SHARD_ENTRIES", 400)
    train, test = [prose(60, s) for s in range(6)], [prose(40, 77), prose(60, 0) * 2, "other Ünicode text", "", None]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(train)], "doc_id long, text string, lang string")
    model = ngram_model.estimate(ngram_model.count_grams(docs))
    turns = list(ngram_model.passes(model))
    sizes = [sum(len(grams) for (_, _, size), (grams, _) in s.value.tables.items() if size > 2) for s in turns[0][1]]
    assert len(turns) == 1 and len(sizes) == turns[0][0] > 3 and max(sizes) < sum(sizes) / 2
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(test)], docs.schema)
    p = brute_model([t.encode() for t in train], ngram_model.ORDER)
    for r in ngram_model.score(rows, model, ["doc_id"]).collect():
        data = (test[r.doc_id] or "").encode()
        grams = [data[i : i + 5] for i in range(len(data) - 4)]
        assert r.grams == len(grams)
        assert r.perplexity == (pytest.approx(math.exp(-sum(math.log(p(g)) for g in grams) / len(grams)), rel=1e-3) if grams else None)


def test_hashes_of_short_words_and_order_by_gram():
    data = np.frombuffer("a bc déf 日本語".encode(), np.uint8)
    start, end = np.array([0, 2, 5, 10, 3]), np.array([1, 4, 9, 19, 3])
    assert textarrays.short_hash(data, start, end).tolist() == textarrays.span_hash(data, start, end).tolist()
    text, gram = np.array([0, 0, 1, 3]), np.array([9, 2, 9, 1], np.uint64)
    for high in (0, 1 << 24):  # with and without room for both in one number
        owner, ordered = ngram_model._by_gram(text + high, gram, 5)
        assert (owner - high).tolist() == [3, 0, 0, 1] and ordered.tolist() == [1, 2, 9, 9]


def test_words_and_lines_are_hashed_from_one_sum(monkeypatch):
    calls, plain = [], textarrays.span_hash
    monkeypatch.setattr(textarrays, "span_hash", lambda *args: calls.append(1) or plain(*args))
    texts = ["a b\n\na b\n \nc", "", "a b\na b a b a b"]
    assert np.stack(quality_rules.text_counts(texts), axis=1).tolist() == [[5, 5, 0, 1, 0], [0, 0, 0, 0, 0], [8, 8, 0, 0, 8]]
    assert len(calls) == 1
