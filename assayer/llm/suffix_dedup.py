"""Removal of repeated byte strings, by collection suffix arrays that are built column by column.

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller id, or same document and earlier
start). Building one suffix array over all documents would take a round for every byte of the longest document, and each
round would read all the rest. Only strings of `length` bytes matter, though, and equal ones share their minimizer: the
smallest hash among the grams of GRAM bytes within. So:

1. Tasks cut each text into segments: runs of string starts whose minimizer is at the same place, a few dozen starts each. Rows
   are (minimizer, hash of the segment's bytes, document, place); the bytes stay behind.
2. Spark drops segments whose minimizer occurs once. Of segments with equal bytes the earliest stays; the others are repeats
   as a whole. What is left are minimizers with different segments around them, in documents that share a passage.
3. Those segments are fetched, dealt into collections of about BATCH strings by minimizer, and each collection's suffixes are
   sorted column by column: round r puts the suffix of length r of every string in its place, which follows from the place of
   the suffix of length r - 1 by the counts of symbols before it in the Burrows-Wheeler transform. Transform, common prefixes
   and places are three sequential files of the collection, each read and written once in a round. Being bounded by BATCH, they
   are held as arrays in the task's memory. Neighbours with a common prefix of `length` are equal strings.
4. A minimizer with more than MAX_KINDS different segments would make its collection too large (a passage that thousands of
   documents go on from differently). Its strings are dealt out by the hash of all their bytes instead, each to a place of its
   own, and Spark takes the earliest of each.

Null and empty texts have no bytes, and texts under `length` lose none. Ids are whole numbers; null ones come last. Rows that
share id and text are one document and are judged alike; rows that share an id only are ordered by a hash of their text. An empty
table gives an empty result. Further columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import storage, textarrays

#: Bytes of the strings that are looked for, and of the grams among which the minimizer is.
LENGTH, GRAM = 100, 40
#: Strings of a collection; different segments that a minimizer may have to go there whole.
BATCH, MAX_KINDS = 4096, 1024
#: String starts of one step over a text.
STEP = 1 << 20
#: Stands for a null id, after all others.
LAST = (1 << 63) - 1

_U = np.uint64
_PLACE_BITS = 21  # of a step and the strings that begin in it


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values, span = np.minimum(values[:-span], values[span:]), span * 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, string starts, minimizer, hash of the bytes) of the segments of texts that stand one after the other; `ends`
    has the end of the text of each byte. Every string within one text begins in exactly one segment."""
    starts, counts, keys = [], [], []
    for a in range(0, len(data) - length + 1, STEP):
        own = data[a : a + STEP + length - 1]
        hashed = textarrays.rolling_hash(own, gram)
        marked = (hashed & ~_U((1 << _PLACE_BITS) - 1)) | np.arange(len(hashed), dtype=_U)
        least = _sliding_min(marked, length - gram + 1)
        place = (least & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(a + np.arange(len(least)) + length <= ends[a : a + len(least)])
        if not len(first):
            continue
        place = place[first]
        heads = np.flatnonzero(np.diff(place, prepend=-1))
        starts.append(a + first[heads])
        counts.append(np.diff(np.append(heads, len(place))))
        keys.append(hashed[place[heads]])
    if not starts:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U))
    start, count, key = map(np.concatenate, (starts, counts, keys))
    return start, count, key, textarrays.span_hash(data, start, start + count - 1 + length)


def _flat(texts: list[str]) -> tuple[textarrays.Bytes, np.ndarray]:
    flat = textarrays.Bytes.of(texts)
    return flat, np.repeat(flat.starts[1:] - 1, np.diff(flat.starts))


def _place(check: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """23 bits of the text's hash, first byte in the text, string starts."""
    return (check.astype(np.int64) << 40) | (start.astype(np.int64) << 8) | count.astype(np.int64)


def _check(text: Column) -> Column:
    return F.shiftright(F.crc32(text.cast("binary")), 9)


def _scan(length: int, gram: int):
    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        flat, ends = _flat(texts)
        start, count, key, content = segments(flat.data, ends, length, gram)
        text = np.searchsorted(flat.starts, start, "right") - 1
        check = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) >> 9 for t in texts), np.int64, len(texts))
        at = _place(check[text], start - flat.starts[text], count)
        doc = batch.column(0).take(pa.array(text))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), doc, pa.array(at)], ["key", "content", "doc", "at"])

    return work


def _fetch(length: int, buckets: int):
    """Rows (bucket, doc, at, piece) of the segments wanted; of those of crowded minimizers a row for each string: (hash, hash, doc, at)."""

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        docs, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = []
        for doc, text, listed in zip(docs, texts, wanted, strict=True):
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            for x in listed:
                start, count = x["at"] >> 8 & 0xFFFFFFFF, x["at"] & 0xFF
                piece = raw[start : start + count - 1 + length]
                if not x["crowded"]:
                    rows.append((int(textarrays.mix(np.array([x["key"]], np.int64).view(_U))[0] % _U(buckets)), None, None, doc, x["at"], piece.tobytes()))
                else:
                    places = np.arange(count)
                    one, two = textarrays.span_hash(piece, places, places + length), textarrays.rolling_hash(piece, length)
                    high = x["at"] >> 40 << 40
                    rows += [(None, int(a), int(b), doc, high | start + i << 8 | 1, None) for i, (a, b) in enumerate(zip(one.view(np.int64).tolist(), two.view(np.int64).tolist(), strict=True))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "one", "two", "doc", "at", "piece"])

    return work


def sort_suffixes(strings: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a collection of strings: (string << 8 | place) of every suffix in order, the ends included, the common prefix of each with the one
    before, at most `cap`, and the transform (0: none before, else the rank of the symbol from 1).

    Strings end in signs of their own, smaller than any symbol, in their order. Round r inserts the suffixes of length r."""
    m = len(strings)
    size = np.fromiter(map(len, strings), np.int64, m)
    symbols, coded = np.unique(np.frombuffer(b"".join(strings), np.uint8), return_inverse=True)
    kind = np.uint8 if len(symbols) < 255 else np.uint16
    coded = np.append(coded + 1, 0).astype(kind)
    begin = np.cumsum(size) - size
    at = lambda which, left: np.where(left > 0, coded[begin[which] + left - 1], 0).astype(kind)  # noqa: E731  the symbol before
    every = np.arange(m)
    transform, common = at(every, size), np.zeros(m, np.uint8)
    code = (every << 8 | size).astype(np.uint32)
    place = every.copy()
    for r in range(1, int(size.max(initial=0)) + 1):
        own = np.flatnonzero(size >= r)
        n = len(transform)
        order = np.argsort(transform, kind="stable")
        ended = n - np.count_nonzero(transform)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        mine = rank[place[own]]
        # the new suffixes and those behind them get their common prefix anew: one more than the least between their tails
        touched = np.zeros(n + 1, bool)
        touched[mine] = touched[mine + 1] = True
        touched[n] = False
        touched = np.flatnonzero(touched)
        touched = touched[touched > ended]
        same = touched[transform[order[touched]] == transform[order[touched - 1]]]
        low, high = order[same - 1] + 1, order[same] + 1
        down = np.argsort(-low)
        least = np.minimum.reduceat(np.append(common, 0), np.stack([low[down], high[down]], axis=1).ravel())[::2] if len(low) else common[:0]
        new = m - ended + mine
        old = np.ones(n + len(own), bool)
        old[new] = False
        grown = []
        for file, added in ((transform, at(own, size[own] - r)), (common, 0), (code, (own << 8 | (size[own] - r)).astype(np.uint32))):
            out = np.empty(n + len(own), file.dtype)
            out[old] = file
            out[new] = added
            grown.append(out)
        transform, common, code = grown
        common[m - ended + same[down]] = np.minimum(least.astype(np.int64) + 1, cap)
        place[own] = new
    return code, common, transform


def repeats(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, last): runs of places in strings where a string of `length` bytes begins that also begins earlier, in
    an earlier string or place."""
    code, common, _ = sort_suffixes(strings, length)
    code = code.astype(np.int64)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    group = np.cumsum(common < length)
    long = np.flatnonzero(size[code >> 8] - (code & 0xFF) >= length)
    code, group = code[long], group[long]
    if not len(code):
        return (np.zeros(0, np.int64),) * 3
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    earliest = np.repeat(np.minimum.reduceat(code, heads), np.diff(np.append(heads, len(code))))
    again = np.sort(code[code > earliest])
    if not len(again):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.diff(again, prepend=again[0] - 2) != 1)
    last = np.append(first[1:], len(again)) - 1
    return again[first] >> 8, again[first] & 0xFF, again[last] & 0xFF


def _collection(length: int):
    def work(table: pa.Table) -> pa.Table:
        doc, at = table["doc"].to_numpy(), table["at"].to_numpy()
        order = np.lexsort((at, doc))
        keep = np.flatnonzero((np.diff(doc[order], prepend=-1) != 0) | (np.diff(at[order], prepend=-1) != 0)) if len(order) else order
        order = order[keep]
        pieces = table["piece"].to_pylist()
        string, first, last = repeats([pieces[i] for i in order.tolist()], length)
        rows = order[string]
        start = at[rows] >> 8 & 0xFFFFFFFF
        return pa.table({"doc": doc[rows], "check": at[rows] >> 40, "low": start + first, "high": start + last + length})

    return work


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH, max_kinds: int = MAX_KINDS) -> DataFrame:
    """(doc, check, low, high): bytes from low to before high go; spans may overlap. doc and check name a document, see `named`."""
    spark = docs.sparkSession
    texts = named(docs, id_col, text_col)
    schema = "key long, content long, doc long, at long"
    rows = storage.stage(textarrays.map_texts(texts.select("doc", "text"), _scan(length, gram), "text", schema), "segments")
    again = storage.stage(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "repeated_minimizers")
    storage.free_shuffles(spark)
    every, rows = rows, storage.stage(rows.join(again, "key"), "shared_segments")
    storage.release(every)
    del every
    storage.free_shuffles(spark)

    contents = rows.groupBy("key", "content").agg(F.min(F.struct("doc", "at")).alias("owner"), F.count("*").alias("copies"))
    contents = storage.stage(contents, "contents")
    kinds = contents.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    wanted = contents.join(kinds, "key").select("key", "owner.doc", "owner.at", (F.col("kinds") > max_kinds).alias("crowded"))
    wanted = storage.stage(wanted, "wanted")
    whole = (F.col("at").bitwiseAND(F.lit(0xFF)) - 1 + length).alias("size")
    first = F.shiftright("at", 8).bitwiseAND(F.lit(0xFFFFFFFF)).alias("low")
    check = F.shiftright("at", 40).alias("check")
    copied = rows.join(contents.filter("copies > 1").select("key", "content", "owner"), ["key", "content"]).filter(F.struct("doc", "at") != F.col("owner"))
    copied = storage.stage(copied.select("doc", check, first, (first + whole).alias("high")), "copied_segments")

    buckets = max(1, wanted.filter("NOT crowded").count() // batch)
    listed = wanted.groupBy("doc", check).agg(F.collect_list(F.struct("key", "at", "crowded")).alias("wanted"))
    found = texts.join(listed, ["doc", "check"]).select("doc", "wanted", "text")
    pieces = storage.stage(
        textarrays.map_texts(found, _fetch(length, buckets), "text", "bucket long, one long, two long, doc long, at long, piece binary"), "pieces"
    )
    storage.free_shuffles(spark)
    storage.release(rows)
    spans = "doc long, check long, low long, high long"
    sorted_ = pieces.filter("bucket IS NOT NULL").groupBy("bucket").applyInArrow(_collection(length), spans)
    single = pieces.filter("bucket IS NULL").select("one", "two", "doc", "at")
    owners = single.groupBy("one", "two").agg(F.min(F.struct("doc", "at")).alias("owner"), F.count("*").alias("copies")).filter("copies > 1")
    crowded = single.join(owners, ["one", "two"]).filter(F.struct("doc", "at") != F.col("owner")).select("doc", check, first, (first + length).alias("high"))
    found = [copied, storage.stage(sorted_, "sorted_repeats"), storage.stage(crowded, "crowded_repeats")]
    storage.release(pieces)
    storage.free_shuffles(spark)
    return reduce(DataFrame.unionByName, found)


def named(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, check, text): how `repeated_spans` names documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), _check(text).alias("check"), text.alias("text"))


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch, as one."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order]) if len(high) else high
    cut = np.flatnonzero(np.append(True, low[1:] > high[:-1])) if len(low) else np.zeros(0, np.int64)
    return low[cut], high[np.append(cut[1:], len(low)) - 1] if len(cut) else high


def _remove(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    spans, kept = [], []
    for text, lows, highs in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        low, high = merged(np.array(lows or [], np.int64), np.array(highs or [], np.int64))
        spans.append([{"low": a, "high": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        ends = [0, *high.tolist()]
        kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*low.tolist(), len(raw)], strict=True)))
    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH, max_kinds: int = MAX_KINDS) -> DataFrame:
    """(doc_id, spans, kept) of each row: the maximal removed runs of bytes, and the remaining bytes."""
    spans = repeated_spans(docs, length, gram, id_col, text_col, batch, max_kinds)
    listed = spans.groupBy("doc", "check").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    met = named(docs, id_col, text_col).join(listed, ["doc", "check"], "left").select("doc", "low", "high", "text")
    done = textarrays.map_texts(met, _remove, "text", "doc long, spans array<struct<low:long,high:long>>, kept binary")
    return done.select(F.when(F.col("doc") < LAST, F.col("doc")).alias("doc_id"), "spans", "kept")
