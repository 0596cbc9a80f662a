"""Modified Kneser-Ney models over byte n-grams, one for each language, counted and estimated in Spark.

A gram of `order` bytes is one 64-bit number, so contexts and suffixes are shifts and masks. Tasks count their grams in
sorted arrays and hand on one row for each gram and task. The highest order takes counts, lower orders take numbers of
different left neighbours; discounts D1, D2, D3+ follow from the counts of counts of each order and language.

The estimated model is a table (lang, kind, size, gram, value): kind p has the log probability of a seen gram, kind b the
log weight that a context gives to shorter ones. To score, it is cut into shards of about SHARD_ENTRIES rows (one frequent
pair of bytes can hold more) by the two bytes before the predicted one; what a position needs is in one shard. The driver has
one at a time and broadcasts it as sorted arrays. As many as `max_entries` rows allow are joined to all documents in one pass;
a document's log probability is the sum over the passes. Texts are never shuffled.

Null or empty texts and texts shorter than `order` have no grams and a null perplexity, as have texts in a language the
model doesn't know. A null language is the language "und".
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import storage, textarrays

ORDER = 5
#: Rows of the shards of one pass, 12 bytes each in a task, and of one shard, all that the driver holds.
MAX_ENTRIES = 6_000_000
SHARD_ENTRIES = 500_000
#: Distinct grams that a task holds before it hands them on.
HELD_GRAMS = 1_000_000
UNKNOWN_LANG = "und"

_U = np.uint64


#: Grams from which on a perplexity counts in full.
FULL_GRAMS = 1000


def deviation(perplexity: Column, median: Column, grams: Column, full: int = FULL_GRAMS) -> Column:
    """Log perplexity against a median, less for short texts: chance alone moves those by 1 / sqrt(grams)."""
    return (F.log(perplexity) - median) * F.sqrt(F.least(grams, F.lit(full)) / full)


def language(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(UNKNOWN_LANG))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(lang, text_key, text): each text of a language once, however many rows have it; copies are combined map-side."""
    return docs.groupBy("lang", F.unhex(F.md5("text")).alias("text_key")).agg(F.first("text").alias("text"))


def byte_grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and gram of each window of `order` bytes within one text."""
    flat = textarrays.Bytes.of(texts)
    n = len(flat.data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    gram = np.zeros(n, _U)
    for j in range(order):
        gram <<= _U(8)
        gram |= flat.data[j : j + n]
    length = np.diff(flat.starts)
    text = np.repeat(np.arange(len(texts)), length)[:n]
    whole = np.ones(len(flat.data), bool)
    for j in range(1, order + 1):  # the byte after a text is not part of it
        whole[np.maximum(flat.starts[1:] - j, 0)] = False
    whole = whole[:n]
    return text[whole], gram[whole]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.diff(grams, prepend=grams[:1] ^ _U(1)))
    return grams[first], np.add.reduceat(counts, first)


#: A function (texts, order) -> (text number, gram), and the order.
Kind = tuple[Callable[[list[str], int], tuple[np.ndarray, np.ndarray]], int]


def _count_task(kinds: dict[str, Kind], accept: Callable[[list[str]], np.ndarray] | None):
    def rows(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, counts = _merge(parts)
            for i in range(0, len(grams), 100_000):
                g, c = grams[i : i + 100_000], counts[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        for batch in batches:
            for a, b in textarrays.slices(batch.column(1)):
                by_lang = defaultdict(list)
                langs, texts = (batch.column(i).slice(a, b - a).to_pylist() for i in (0, 1))
                texts = [t or "" for t in texts]
                wanted = accept(texts).tolist() if accept else [True] * len(texts)
                for lang, text, take in zip(langs, texts, wanted, strict=True):
                    if take:
                        by_lang[lang].append(text)
                for mark, (find, order) in kinds.items():
                    for lang, texts in by_lang.items():
                        grams, counts = np.unique(find(texts, order)[1], return_counts=True)
                        if len(grams):
                            own = held[mark + lang]
                            own.append((grams, counts))
                            if sum(len(g) for g, _ in own) > 4 * len(own[0][0]) + 500_000:
                                held[mark + lang] = [_merge(own)]
                if sum(len(g) for parts in held.values() for g, _ in parts) > HELD_GRAMS:
                    yield from rows(held)
                    held.clear()
        yield from rows(held)

    return run


def count_grams(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER,
    accept: Callable[[list[str]], np.ndarray] | None = None, kinds: dict[str, Kind] | None = None,
) -> DataFrame:
    """(lang, gram, n) over all documents, or those that `accept` marks. kinds: several kinds of grams in one pass, by what is put before
    the language."""
    return gram_rows(docs, lang_col, text_col, order, accept, kinds).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_rows(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER,
    accept: Callable[[list[str]], np.ndarray] | None = None, kinds: dict[str, Kind] | None = None,
) -> DataFrame:
    """The (lang, gram, n) of each task, for count_grams to add up."""
    kinds = kinds or {"": (byte_grams, order)}
    textarrays.ship_code(docs.sparkSession)
    named = docs.select(language(docs[lang_col]).alias("lang"), docs[text_col].alias("text"))
    return named.mapInArrow(_count_task(kinds, accept), "lang string, gram long, n long")


def _discounts(levels: DataFrame) -> DataFrame:
    """D1, D2, D3 of each order and language: one row for each. What the counts don't give, or give outside (0, i], is i / 2."""
    of = [F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)]
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))

    def discount(i: int) -> Column:
        d = i - (i + 1) * y * F.try_divide(f"n{i + 1}", f"n{i}")
        return F.coalesce(F.when((d > 0) & (d <= i), d), F.lit(i / 2)).alias(f"d{i}")

    return levels.groupBy("k", "lang").agg(*of).select("k", "lang", *[discount(i) for i in (1, 2, 3)])


def estimate(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """The model table from counts of the highest order. A context has at most 256 grams, so its totals are sums over a window."""
    levels = {order: storage.stage(counts, "grams")}
    for k in range(order - 1, 0, -1):
        shorter = levels[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram"))
        levels[k] = storage.stage(shorter.agg(F.count("*").alias("n")), f"left_neighbours_{k}")
    every = reduce(DataFrame.unionByName, [level.select(F.lit(k).alias("k"), "lang", "n") for k, level in levels.items()])
    discounts = storage.stage(_discounts(every), "discounts")
    parts, below = [], None
    for k in range(1, order + 1):
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        cut = levels[k].join(F.broadcast(discounts.filter(F.col("k") == k).drop("k")), "lang")
        cut = cut.select("lang", "gram", F.shiftright("gram", 8).alias("context"), "n", off.alias("off"))
        context = Window.partitionBy("lang", "context")
        total, freed = F.sum("n").over(context), F.sum("off").over(context)
        first = F.col("gram") == F.min("gram").over(context)
        cut = cut.select("lang", "gram", ((F.col("n") - F.col("off")) / total).alias("share"), (freed / total).alias("weight"), first.alias("first"))
        if k == 1:
            lower = cut.withColumn("lower", F.lit(1 / 256))
        else:
            known = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            lower = cut.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(known, ["lang", "suffix"])
        p = F.col("share") + F.col("weight") * F.col("lower")
        below = storage.stage(lower.select("lang", "gram", p.alias("p"), "weight", "first"), f"probabilities_{k}")
        parts.append(below.select("lang", F.lit("p").alias("kind"), F.lit(k).alias("size"), "gram", F.log("p").cast("float").alias("value")))
        context = F.shiftright("gram", 8).alias("gram")
        parts.append(below.filter("first").select("lang", F.lit("b").alias("kind"), F.lit(k - 1).alias("size"), context, F.log("weight").cast("float").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def _shard_number(two_bytes, shards: int):
    """By the high bits of a product, in which all bits of the two bytes count."""
    return two_bytes * 40503 % 65536 * shards


@dataclass
class Shard:
    """The part of the models that positions with certain two bytes before them need: for each (lang, kind, size) grams in order with
    their values."""

    order: int
    number: int
    shards: int
    langs: list[str]
    tables: dict[tuple[str, str, int], tuple[np.ndarray, np.ndarray]]

    def log_probability(self, lang: str, gram: np.ndarray) -> np.ndarray:
        """Of each gram's last byte after the others; backs off to shorter contexts where a gram is new."""
        out = np.zeros(len(gram), np.float32)
        todo = np.arange(len(gram))
        for k in range(self.order, 0, -1):
            cut = gram[todo] & _U((1 << 8 * k) - 1)
            found = _looked_up(self.tables[lang, "p", k], cut)
            new = np.isnan(found)
            out[todo[~new]] += found[~new]
            todo, cut = todo[new], cut[new]
            if not len(todo):
                break
            out[todo] += np.nan_to_num(_looked_up(self.tables[lang, "b", k - 1], cut >> _U(8)), nan=0.0)
        out[todo] += np.float32(-np.log(256)) if len(todo) else 0
        return out


def _looked_up(table: tuple[np.ndarray, np.ndarray], gram: np.ndarray) -> np.ndarray:
    """NaN where a gram isn't there."""
    keys, values = table
    if not len(keys):
        return np.full(len(gram), np.nan, np.float32)
    at = np.searchsorted(keys, gram)
    at[at == len(keys)] = 0
    return np.where(keys[at] == gram, values[at], np.float32(np.nan))


def _by_gram(text: np.ndarray, gram: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Both, in the order of the grams; text numbers ascend. As one number where it has room for both, as sorting those is faster."""
    bits = 64 - 8 * order
    if len(text) and int(text[-1]) >> bits == 0:
        key = np.sort(gram << _U(bits) | text.astype(_U))
        return (key & _U((1 << bits) - 1)).astype(np.int64), key >> _U(bits)
    place = np.argsort(gram, kind="stable")
    return text[place], gram[place]


def text_sums(shards: list[Shard], lang: str, text: np.ndarray, gram: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the log probability and the number of those grams that the shards have. A gram is looked up once, however often the
    texts have it."""
    text, gram = _by_gram(text, gram, shards[0].order)
    first = np.flatnonzero(np.diff(gram, prepend=~gram[:1]))
    often, distinct = np.diff(first, append=len(gram)), gram[first]
    value, mine = np.zeros(len(distinct)), np.zeros(len(distinct), bool)
    number = _shard_number((distinct >> _U(8) & _U(0xFFFF)).astype(np.int64), shards[0].shards) >> 16
    for shard in shards:
        own = np.flatnonzero(number == shard.number)
        value[own], mine[own] = shard.log_probability(lang, distinct[own]), True
    return np.bincount(text, np.repeat(value, often), texts), np.bincount(text[np.repeat(mine, often)], minlength=texts)


def shards_of(model: DataFrame, order: int, max_entries: int) -> Iterator[Shard]:
    """Collects one shard at a time. Grams of two bytes at most are in every shard: 2**17 rows for a language at most."""
    entries = {r.lang: r.n for r in model.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(entries)
    if not langs:
        yield Shard(order, 0, 1, [], {})
        return
    tables = [(lang, kind, size) for lang in langs for size in range(order + 1) for kind in "pb"]
    lang_number = F.create_map(*[x for n, lang in enumerate(langs) for x in (F.lit(lang), F.lit(n))])[F.col("lang")]
    number_of = (lang_number * (order + 1) + F.col("size")) * 2 + (F.col("kind") == "b").cast("int")
    shards = -(-sum(entries.values()) // max_entries)
    two = F.when(F.col("kind") == "p", F.shiftright("gram", 8)).otherwise(F.col("gram")).bitwiseAND(F.lit(0xFFFF))
    everywhere = F.col("size") < F.when(F.col("kind") == "p", F.lit(3)).otherwise(F.lit(2))
    shard = F.when(everywhere, -1).otherwise(F.shiftright(_shard_number(two, shards), 16).cast("int"))
    numbered = model.select(shard.alias("shard"), number_of.alias("n"), "gram", "value")
    if shards > 1:  # sorted, so that a shard's rows are found without a scan of all
        numbered = storage.stage(numbered.sortWithinPartitions("shard"), "shards")
    for number in range(shards):
        own = numbered.filter(F.col("shard").isin(-1, number)) if shards > 1 else numbered
        yield Shard(order, number, shards, langs, _tables(own.select("n", "gram", "value").toArrow(), tables))


def _tables(rows: pa.Table, tables: list[tuple[str, str, int]]) -> dict[tuple[str, str, int], tuple[np.ndarray, np.ndarray]]:
    table, gram, value = (rows[c].to_numpy() for c in ("n", "gram", "value"))
    place = np.lexsort((gram.view(_U), table))
    cuts = np.searchsorted(table[place], np.arange(len(tables) + 1))
    return {t: (gram[place[a:b]].view(_U), value[place[a:b]]) for t, a, b in zip(tables, cuts, cuts[1:], strict=False)}


def passes(model: DataFrame, order: int = ORDER, max_entries: int = MAX_ENTRIES) -> Iterator[tuple[int, list[Broadcast]]]:
    """The number of shards, and broadcast ones of together about max_entries rows; the driver holds one shard at a time."""
    context = model.sparkSession.sparkContext
    each = max(1, max_entries // SHARD_ENTRIES)
    shared = []
    for shard in shards_of(model, order, min(max_entries, SHARD_ENTRIES)):
        shards, last = shard.shards, shard.number + 1 == shard.shards
        shared.append(context.broadcast(shard))
        del shard
        if len(shared) == each or last:
            yield shards, shared
            shared = []


@dataclass
class Extra:
    """Further columns that the scoring pass makes from the texts: names with types, and a function of texts and languages."""

    fields: dict[str, str]
    work: Callable[[list[str], list[str]], list]

    def columns(self, texts: list[str], langs: list[str]) -> list[pa.Array]:
        kinds = {"double": pa.float64(), "long": pa.int64()}
        return [pa.array(c, kinds[k]) for c, k in zip(self.work(texts, langs), self.fields.values(), strict=True)]


def whole_model(model: DataFrame, order: int) -> list[Broadcast]:
    """All shards of a model of bounded size."""
    return [shared for _, some in passes(model, order) for shared in some]


def _score_task(shared: list[Broadcast], order: int, n_keep: int, names: list[str], extra: Extra | None):
    """Rows: n_keep columns that stay, language, text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [s.value for s in shared]
        for batch in batches:
            for a, b in textarrays.slices(batch.column(n_keep + 1)):
                part = batch.slice(a, b - a)
                langs = np.array(part.column(n_keep).to_pylist(), object)
                listed = [t or "" for t in part.column(n_keep + 1).to_pylist()]
                texts = np.array(listed, object)
                total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                for lang in set(langs.tolist()) & set(shards[0].langs if shards else []):
                    rows = np.flatnonzero(langs == lang)
                    total[rows], n[rows] = text_sums(shards, lang, *byte_grams(texts[rows].tolist(), order), len(rows))
                more = extra.columns(listed, langs.tolist()) if extra else []
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], pa.array(total), pa.array(n), *more], names)

    return run


def score(
    docs: DataFrame, model: DataFrame, keep: list[str], lang_col: str = "lang", text_col: str = "text",
    order: int = ORDER, max_entries: int = MAX_ENTRIES, extra: Extra | None = None,
) -> DataFrame:
    """The columns in `keep` of each document, its perplexity per byte, its number of grams, and the extra columns."""
    textarrays.ship_code(docs.sparkSession)
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    lang, text = language(F.col(lang_col)).alias("_lang"), F.col(text_col).alias("_text")

    def partial(shared: list[Broadcast], rows: DataFrame, extra: Extra | None = None) -> DataFrame:
        fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields[:-2]} | {"total": "double", "grams": "long"} | (extra.fields if extra else {})
        task = _score_task(shared, order, len(rows.columns) - 2, list(fields), extra)
        return rows.mapInArrow(task, ", ".join(f"`{name}` {kind}" for name, kind in fields.items()))

    turns = passes(model, order, max_entries)
    shards, shared = next(turns)
    if len(shared) == shards:
        scored = partial(shared, docs.select(*kept, lang, text), extra)
    else:  # the sums of a text are the same wherever it stands, so texts are the key
        key = F.unhex(F.md5(F.concat_ws("\x00", language(F.col(lang_col)), F.coalesce(F.col(text_col), F.lit(""))))).alias("key")
        parts = []
        for _, shared in chain([(shards, shared)], turns):  # given up when their sums are written
            one = partial(shared, docs.select(key, lang, text))
            parts.append(storage.stage(one.groupBy("key").agg(F.max("total").alias("total"), F.max("grams").alias("grams")), "partial_sums"))
            for shard in shared:
                shard.destroy()
        sums = reduce(DataFrame.union, parts).groupBy("key").agg(F.sum("total").alias("total"), F.sum("grams").alias("grams"))
        rows = docs.select(*kept, key, lang, text)
        if extra:
            rows = partial([], rows, extra).drop("total", "grams")
        scored = rows.join(sums, "key")
    perplexity = F.when(F.col("grams") > 0, F.exp(-F.col("total") / F.col("grams"))).alias("perplexity")
    return scored.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], perplexity, "grams", *(extra.fields if extra else {}))
