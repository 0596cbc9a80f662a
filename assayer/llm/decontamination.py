"""Benchmark decontamination by spaced-seed hashing.

A mask picks some of the word positions of a window; the others may differ. Hashes of all masked windows of the test
items are joined to those of every document; around a hit, the words along its diagonal are compared and every stretch
that holds enough agreeing words is kept: the best first, +1 for a word that agrees, -2 for one that doesn't, then the best
on either side of it, and so on. A document is contaminated where there is such a stretch.

The test side is a stated query set: it is sent to the tasks in blocks of at most MAX_SEEDS hashes, each of which meets
all documents, so memory stays bounded whatever its size; a block's result is written and its broadcast given up before the
next block is read. Documents aren't shuffled.

Words are runs of ASCII letters and digits (A-Z in lower case) and of characters beyond ASCII. Null or empty texts and
items overlap with nothing; neither does an empty table. Repeated items or documents each give their own rows. An item of
fewer words than any mask spans has one window, all of it, and is found where all its words stand; columns besides id and text
pass through.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import storage, textarrays

#: Positions that count are 1. An unspaced mask for short items comes last.
MASKS = ("1101100111", "1110010111", "1011011011", "11111")
#: Agreeing words that a stretch needs, or all words of a shorter item.
MIN_WORDS = 10
#: Hashes of one block of test items: 16 bytes each in a task.
MAX_SEEDS = 2_000_000

_U = np.uint64
OVERLAPS = "doc_id {id}, item_id {item}, doc_start long, item_start long, n_words long, n_agree long"


def seeds(words: textarrays.Spans, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each masked window within one text."""
    n = len(words.hash) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    value = np.full(n, int(mask, 2), _U)
    for j, picked in enumerate(mask):
        if picked == "1":
            value *= _U(0x9E3779B97F4A7C15)
            value += words.hash[j : j + n]
    first = np.flatnonzero(words.text[:n] == words.text[len(mask) - 1 :])
    return first, textarrays.mix(value[first])


class SeedTable:
    """Sorted hashes of one block of items; what a task looks documents up in."""

    def __init__(self, items: list[str], masks: tuple[str, ...]):
        self.masks = masks
        words = textarrays.spans(textarrays.Bytes.of(items), textarrays.NOT_ALNUM, lower=True)
        self.words, self.first = words.hash, textarrays.group_starts(words.text, len(items))
        # items that no mask fits in are found by a window of their own length
        size = np.diff(self.first)[words.text]
        shortest = min(map(len, masks))
        self.whole = ["1" * n for n in sorted(set(size[size < shortest].tolist()))]
        found = [seeds(words, mask) for mask in masks]
        for mask in self.whole:
            at, value = seeds(words, mask)
            fits = size[at] == len(mask)
            found.append((at[fits], value[fits]))
        place, value = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(value, kind="stable")
        self.value, self.place = value[order], place[order]
        self.item = words.text[self.place]
        self.shift = _U(64 - max(16, min(24, int(len(value)).bit_length() + 5)))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[(self.value >> self.shift).astype(np.int64)] = True

    def hits(self, words: textarrays.Spans) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word of the documents, word of the items) where masked windows agree."""
        left, right = [], []
        for mask in (*self.masks, *self.whole):
            at, value = seeds(words, mask)
            near = np.flatnonzero(self.maybe[(value >> self.shift).astype(np.int64)])
            at, value = at[near], value[near]
            low, high = np.searchsorted(self.value, value), np.searchsorted(self.value, value, "right")
            n = high - low
            left.append(np.repeat(at, n))
            right.append(self.place[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return np.concatenate(left), np.concatenate(right)


def best_stretch(agrees: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch with the largest sum of +1 and -2; the earliest if several have it."""
    sums = np.concatenate(([0], np.cumsum(np.where(agrees, 1, -2))))
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    return int(np.argmin(sums[: end + 1])), end


def stretches(agrees: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """The best stretch and the best ones of what is left on either side, as far as they hold enough agreeing words."""
    out, open_ = [], [(0, len(agrees))]
    while open_:
        low, high = open_.pop()
        if high - low < enough or int(agrees[low:high].sum()) < enough:
            continue
        a, b = best_stretch(agrees[low:high])
        if int(agrees[low + a : low + b].sum()) >= enough:
            out.append((low + a, low + b))
        open_ += [(low + b, high), (low, low + a)]
    return sorted(out)


def compare(table: SeedTable, words: textarrays.Spans, firsts: np.ndarray, min_words: int) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, start in text, start in item, words, agreeing words) of each verified overlap."""
    left, right = table.hits(words)
    if not len(left):
        return []
    text, item = words.text[left], np.searchsorted(table.first, right, "right") - 1
    offset = (left - firsts[text]) - (right - table.first[item])
    lines = np.unique(np.stack([text, item, offset], axis=1), axis=0)
    out = []
    for t, i, d in lines.tolist():
        item_words = table.words[table.first[i] : table.first[i + 1]]
        text_words = words.hash[firsts[t] : firsts[t + 1]]
        low, high = max(0, -d), min(len(item_words), len(text_words) - d)
        agrees = item_words[low:high] == text_words[low + d : high + d]
        for a, b in stretches(agrees, min(min_words, len(item_words))):
            out.append((t, i, low + a + d, low + a, b - a, int(agrees[a:b].sum())))
    return out


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, masks: tuple[str, ...], max_seeds: int):
    """Lists of (id, text) of at most about max_seeds hashes, collected one at a time."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size * len(masks) // (4 * max_seeds)))  # a word takes 4 characters at least, on average
    for block in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()]


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    min_words: int = MIN_WORDS,
    max_seeds: int = MAX_SEEDS,
) -> DataFrame:
    """One row for each verified overlap; positions and lengths are in words."""
    kinds = {"id": docs.select(id_col).schema[0].dataType.simpleString(), "item": benchmark.select(item_id).schema[0].dataType.simpleString()}
    schema = OVERLAPS.format(**kinds)
    named = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    parts, pending = [], None
    for block in filter(None, _blocks(benchmark, item_id, item_text, masks, max_seeds)):
        if pending:
            parts.append(settle(*pending))
        shared = docs.sparkSession.sparkContext.broadcast([t for _, t in block])
        found = textarrays.map_texts(named, _scan(shared, pa.array([i for i, _ in block]), masks, min_words), "_text", schema)
        pending = (found, shared)
    parts += [pending[0]] if pending else []
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def settle(found: DataFrame, shared) -> DataFrame:
    """The result of a block as a table, its broadcast destroyed."""
    staged = storage.stage(found, "block")
    shared.destroy()
    return staged


def _scan(shared, ids: pa.Array, masks: tuple[str, ...], min_words: int):
    built: list[SeedTable] = []

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        if not built:
            built.append(SeedTable(shared.value, masks))
        words = textarrays.spans(textarrays.Bytes.of(texts), textarrays.NOT_ALNUM, lower=True)
        found = compare(built[0], words, textarrays.group_starts(words.text, len(texts)), min_words)
        text, item, *numbers = zip(*found, strict=True) if found else [()] * 6
        columns = [batch.column(0).take(pa.array(text, pa.int64())), ids.take(pa.array(item, pa.int64()))]
        columns += [pa.array(x, pa.int64()) for x in numbers]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_agree"])

    return work


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    min_words: int = MIN_WORDS,
    max_seeds: int = MAX_SEEDS,
) -> DataFrame:
    """Documents without any overlap, all columns as they are. Each block of items is one more filter, without a shuffle."""
    shared = None
    for block in filter(None, _blocks(benchmark, item_id, item_text, masks, max_seeds)):
        if shared is not None:
            docs = settle(docs, shared)
        shared = docs.sparkSession.sparkContext.broadcast([t for _, t in block])
        docs = textarrays.map_rows(docs, _clean_rows(shared, masks, min_words), text_col)
    return docs


def _clean_rows(shared, masks: tuple[str, ...], min_words: int):
    built: list[SeedTable] = []

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        if not built:
            built.append(SeedTable(shared.value, masks))
        words = textarrays.spans(textarrays.Bytes.of(texts), textarrays.NOT_ALNUM, lower=True)
        clean = np.ones(len(texts), bool)
        clean[[o[0] for o in compare(built[0], words, textarrays.group_starts(words.text, len(texts)), min_words)]] = False
        return batch.filter(pa.array(clean))

    return work
