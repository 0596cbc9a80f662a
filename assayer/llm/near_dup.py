"""Near-duplicate groups by b-bit MinHash.

1. Every text becomes its set of word shingles (64-bit hashes). Equal sets are one representative from here on, so copies
   cost one row, however many there are.
2. Band keys of BAND_ROWS minima put representatives in buckets. As many bands as make the chance that a pair at the
   threshold shares none at most MISS. Buckets with one member end here.
3. Members get their full set and a packed signature of the SKETCH low bit pairs of minima, mixed once more. Similarity is estimated by bit
   counts, corrected for chance agreement; a pair stays if the estimate is within SIGMAS deviations of the threshold. Bits that tell
   which of PARITY slots hold an odd number of shingles differ in no more places than the sets do: a pair whose bits differ in more than
   the threshold allows goes for certain, however many pairs lie just below it.
4. First every member is held against the smallest of its bucket. What the confirmed links join is one component; then
   only members outside their bucket's largest component are held against members of other components. So a group of copies
   costs rows in proportion to its size. Buckets with more than CROWDED members outside (a passage that many different texts
   share) are split anew by the members' rarest shingles, of which similar sets share one.
5. Links are confirmed on the full sets; components follow by rounds of large and small stars.

Nulls and edge cases: null, empty or blank text has no set and is linked with nothing; fewer words than a shingle make one
shingle of the whole sequence. Rows with a null id take part and come out with a null id and kept = false unless nothing
smaller is in their group (a group of null ids only keeps the first of them). Rows that share an id count as one document:
they share the component. Columns other than id and text aren't read by `near_duplicates`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import storage, textarrays

BAND_ROWS, MISS = 4, 1e-7
SKETCH, LOW_BITS, SIGMAS = 1024, 2, 4.5
#: Slots whose parities are kept; sets that differ in many more shingles aren't told apart by them.
PARITY = 1024
#: Members outside a bucket's largest component that are held against the bucket directly.
CROWDED = 32
#: Slots in which the shingles of crowded buckets are counted.
SLOTS = 1 << 18
#: Rows without an id are numbered from here; no real id may be as large.
NO_ID = 1 << 62

_U, _HALF = np.uint64, np.uint32
#: Permuted values that are held at once: they stay in a core's cache.
_STEP = 1 << 17


def bands_for(threshold: float, miss: float = MISS) -> int:
    """Bands of BAND_ROWS minima that lose a pair at the threshold with a chance of `miss` at most."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-(threshold**BAND_ROWS)))) if threshold < 1 else 1


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    draws = random.integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return draws[0] * _U(2) + _U(1), textarrays.mix(draws[1])


def minima(shingles: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The smallest permuted value of a set under each permutation, in steps of bounded memory.

    The low halves of hashes and permutations are taken, which are hashes and permutations too: two different shingles of a pair of sets
    share one with a chance of 2**-32, and pairs are confirmed by whole hashes."""
    shingles, factors, masks = (x.astype(_HALF) for x in (shingles, factors, masks))
    best = np.full(len(factors), np.iinfo(_HALF).max, _HALF)
    step = max(1, _STEP // max(1, len(factors)))
    for i in range(0, len(shingles), step):
        values = shingles[i : i + step, None] ^ masks
        values *= factors
        np.minimum(best, values.min(axis=0), out=best)
    return best.astype(_U)


def places(shingles: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The minima, each mixed with its permutation: the low bits of a product follow from the shingle's low bits alone, so
    without it two different minima would agree under all permutations or under none."""
    return textarrays.mix(minima(shingles, factors, masks) ^ factors)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = textarrays.spans(textarrays.Bytes.of(texts), textarrays.SPACES, lower=True)
    count = textarrays.group_starts(words.text, len(texts))
    first, value = textarrays.windows(words, width)
    cut = textarrays.group_starts(words.text[first], len(texts))
    out = []
    for i in range(len(texts)):
        n = count[i + 1] - count[i]
        if 0 < n < width:
            whole = reduce(lambda x, h: x * 31 + int(h) & (1 << 64) - 1, words.hash[count[i] : count[i + 1]].tolist(), int(n))
            out.append(textarrays.mix(np.array([whole], _U)))
        else:
            mine = np.sort(value[cut[i] : cut[i + 1]])
            out.append(mine[np.concatenate(([True], mine[1:] != mine[:-1]))] if len(mine) else mine)
    return out


def set_digest(shingles: np.ndarray) -> bytes | None:
    """128 bits of a set; none for the empty set."""
    if not len(shingles):
        return None
    return np.array([shingles.sum(dtype=_U), textarrays.mix(shingles ^ _U(0x5BD1E995)).sum(dtype=_U)], _U).tobytes()


def pack(low: np.ndarray) -> np.ndarray:
    """Bit planes of the lowest bits, as signed 64-bit numbers."""
    planes = [np.packbits(((low >> _U(b)) & _U(1)).astype(np.uint8)).view(np.int64) for b in range(LOW_BITS)]
    return np.concatenate(planes)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Of each slot, whether an odd number of shingles falls there, packed: two sets differ in as many shingles as slots at least."""
    odd = np.bincount((shingles >> _U(32)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64) if values.dtype == _U else values, kind))


def _with_bands(width: int, bands: int):
    factors, masks = permutations(bands * BAND_ROWS)

    def keys(sets: list[np.ndarray]) -> list[np.ndarray]:
        rows = np.array([minima(s, factors, masks) for s in sets if len(s)], _U).reshape(-1, bands, BAND_ROWS)
        value = np.broadcast_to(np.arange(bands, dtype=_U), rows.shape[:2])
        for j in range(BAND_ROWS):
            value = textarrays.mix(value * _U(0x9E3779B97F4A7C15) + rows[:, :, j])
        found = iter(value)
        return [next(found) if len(s) else np.zeros(0, _U) for s in sets]

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        sets = shingle_sets(texts, width)
        columns = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(set_digest, sets), pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, _lists(keys(sets), pa.int64())], ["node", "text_key", "n_shingles", "digest", "bands"])

    return work


def _with_sketch(width: int):
    factors, masks = permutations(SKETCH)

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        sets = shingle_sets(texts, width)
        packed = _lists([np.concatenate([pack(places(s, factors, masks)), parities(s)]) for s in sets], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(map(set_digest, sets), pa.binary()), _lists(sets, pa.int64()), packed], ["digest", "shingles", "sketch"])

    return work


WORDS, ODD_WORDS = SKETCH // 64, PARITY // 64
SKETCH_COLUMNS = [f"s{i}" for i in range(LOW_BITS * WORDS + ODD_WORDS)]


def sketch_columns(sketch: str) -> list[Column]:
    """A packed signature and its parities as columns s0, s1, ... of their own, as `estimate` and `differing` read them."""
    return [F.coalesce(F.get(sketch, F.lit(i)), F.lit(0)).alias(c) for i, c in enumerate(SKETCH_COLUMNS)]


def without_nulls(df: DataFrame) -> DataFrame:
    """Staged signatures again as columns that can't be null. With a null check for each, or as arrays, the code that compares two of them is
    beyond the 8000 bytes up to which the JVM compiles a method, and a join that holds it is interpreted for every pair."""
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in SKETCH_COLUMNS})


def _xor(a: str, b: str, i: int) -> Column:
    return F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))


def estimate(a: str, b: str) -> Column:
    """Similarity from packed signatures of two sides of a join: share of agreeing places, less what agrees by chance."""
    differs = [reduce(Column.bitwiseOR, [_xor(a, b, p * WORDS + i) for p in range(LOW_BITS)]) for i in range(WORDS)]
    agree = 1 - reduce(Column.__add__, map(F.bit_count, differs)) / float(SKETCH)
    chance = 0.5**LOW_BITS
    return (agree - chance) / (1 - chance)


def differing(a: str, b: str) -> Column:
    """How many shingles at least one of two sets has and the other hasn't."""
    return reduce(Column.__add__, [F.bit_count(_xor(a, b, LOW_BITS * WORDS + i)) for i in range(ODD_WORDS)])


def estimate_floor(threshold: float) -> float:
    """The smallest estimate that a pair at the threshold has, but for SIGMAS deviations."""
    chance = 0.5**LOW_BITS
    agree = threshold + (1 - threshold) * chance
    return threshold - SIGMAS * math.sqrt(agree * (1 - agree) / SKETCH) / (1 - chance)


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, component): the smallest node that a node can reach, for all that reach a smaller one. Large and small stars in turn, staged."""
    edges = storage.stage(edges.select("a", "b").filter("a <> b"), name)
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").filter("b <> low").select("b", F.col("low").alias("low")).union(low.select("a", "low"))
        edges = storage.stage(small.toDF("a", "b").distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        seen = now


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; in whole numbers, so that the threshold itself counts."""
    ours = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    theirs = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    percent = round(100 * threshold)
    return (
        pairs.join(ours, "a").join(theirs, "b")
        .select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
        .filter(100 * F.col("common") >= percent * (F.col("total") - F.col("common")))
        .select("a", "b")
    )


def _open_keys(placed: DataFrame) -> DataFrame:
    """(key, main, outside) of buckets whose members aren't all in one component yet; main: the largest, outside: members of others."""
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    found = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("n"))
    outside = (F.col("n") - F.col("top.n")).alias("outside")
    return storage.stage(found.filter("parts > 1").select("key", F.col("top.component").alias("main"), outside), "open_keys")


def _across(placed: DataFrame, brief: DataFrame, plausible: Callable[[str, str], Column], unless: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Plausible pairs (a, b) of a bucket's members in different components, one of them outside the largest; `unless` leaves out pairs
    that meet elsewhere."""
    met = without_nulls(storage.stage(placed.join(brief, "rep"), "open_members"))
    x, y = met.filter("component <> main").alias("x"), met.alias("y")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep"))
    likely = once & plausible("x", "y")
    likely = likely if unless is None else likely & ~unless("x", "y")  # last, as it compares whole lists
    apart = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & likely)
    return apart.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _count_slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shingles): rows (slot, n) for the slots of a task's shingles."""
    often = np.zeros(SLOTS, np.int64)
    for batch in batches:
        often += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False) & (SLOTS - 1), minlength=SLOTS)
    slot = np.flatnonzero(often)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(often[slot])], ["slot", "n"])


def _rarest(shared: Broadcast, percent: int):
    """Of rows (rep, component, shingles): rows (key, rep, component, nth) of each set's rarest shingles that another set may have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            key = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            n = often[key & (SLOTS - 1)]
            order = np.lexsort((key, n, row))
            key, row, n = key[order], row[order], n[order]
            nth = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            keep = (nth < size[row] - -(-size[row] * percent // 100) + 1) & (n > 1)
            rows = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(nth[keep])], ["key", "rep", "component", "nth"])

    return run


def _by_rare_shingles(placed: DataFrame, sets: DataFrame, brief: DataFrame, threshold: float, plausible: Callable[[str, str], Column]) -> DataFrame:
    """The same for crowded buckets, split anew: two sets that are similar enough share one of their rarest shingles.

    Of a set of n, in any order that all sets follow, the first n - ceil(threshold * n) + 1 meet those of every set as similar.
    The order is by how often the members have shingles of the same slot, so a passage that all share comes last. Any order loses no pair;
    slots keep what is sent to the tasks at SLOTS numbers."""
    members = storage.stage(placed.select("rep", "component").distinct().join(sets.select("rep", "shingles"), "rep"), "crowded_members")
    counted = members.select("shingles").mapInArrow(_count_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # SLOTS rows at most
    often = np.zeros(SLOTS, np.int64)
    often[[r.slot for r in counted]] = [r.n for r in counted]
    shared = placed.sparkSession.sparkContext.broadcast(often)
    rare = members.mapInArrow(_rarest(shared, round(100 * threshold)), "key long, rep long, component long, nth long")
    rare = storage.stage(rare, "rare_shingles")
    # all of a set's rare shingles, the rarest first: a pair is held together by the first that it shares only
    lists = rare.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "key"))), lambda x: x["key"]).alias("rare"))
    first = lambda a, b: F.get(F.array_intersect(f"{a}.rare", f"{b}.rare"), F.lit(0)) != F.col(f"{a}.key")
    return _across(rare.join(_open_keys(rare).select("key", "main"), "key").select("key", "rep", "component", "main"), brief.join(lists, "rep"), plausible, first)


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept. The threshold counts in whole percents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.monotonically_increasing_id()).alias("node"),
        F.unhex(F.md5(text)).alias("text_key"), text.alias("_text"),
    )
    bands = bands_for(threshold)
    schema = "node long, text_key binary, n_shingles long, digest binary, bands array<long>"
    rows = storage.stage(textarrays.map_texts(named, _with_bands(width, bands), "_text", schema), "bands")

    by_set = rows.filter("digest IS NOT NULL").groupBy("digest")
    reps = storage.stage(
        by_set.agg(F.min("node").alias("rep"), F.first("text_key").alias("text_key"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")),
        "representatives",
    )
    keyed = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    # staged, so that the joins that follow shuffle each side for themselves and a crowded key can be split between tasks
    shared = storage.stage(keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("hub")).filter("size > 1"), "shared_keys")
    members = storage.stage(keyed.join(shared, "key"), "members")

    wanted = members.select("rep").distinct().join(reps, "rep")
    again = named.join(wanted.select("text_key"), "text_key", "left_semi").select("_text")
    sets = storage.stage(
        textarrays.map_texts(again, _with_sketch(width), "_text", "digest binary, shingles array<long>, sketch array<long>")
        .groupBy("digest").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))
        .join(wanted.select("digest", "rep", "bands"), "digest").drop("digest"),
        "sets",
    )
    floor, ratio, percent = estimate_floor(threshold), threshold - 1e-9, round(100 * threshold)

    def plausible(a: str, b: str) -> Column:
        sizes = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= ratio * F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
        close = differing(a, b) * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")).cast("long") * (100 - percent)
        return sizes & close & (estimate(a, b) >= floor)

    brief = sets.select("rep", F.size("shingles").alias("n"), *sketch_columns("sketch"))
    stars = members.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    near = (
        stars.join(brief.alias("x"), F.col("a") == F.col("x.rep")).join(brief.alias("y"), F.col("b") == F.col("y.rep"))
        .filter(plausible("x", "y")).select("a", "b")
    )
    links = storage.stage(_confirmed(near, sets, threshold), "links")
    first = components(links)

    placed = members.join(first.withColumnRenamed("node", "rep"), "rep", "left")
    placed = storage.stage(placed.select("key", "band", "rep", F.coalesce("component", "rep").alias("component")), "placed_members")
    open_keys = _open_keys(placed)
    small, crowded = open_keys.filter(F.col("outside") <= CROWDED), open_keys.filter(F.col("outside") > CROWDED)
    # a pair is held together in the first bucket it shares only
    earlier = lambda a, b: F.exists(F.sequence(F.lit(0), F.col(f"{a}.band")), lambda i: (i < F.col(f"{a}.band")) & (F.get(f"{a}.bands", i) == F.get(f"{b}.bands", i)))
    few = _across(placed.join(small, "key").select("key", "band", "rep", "component", "main"), brief.join(sets.select("rep", "bands"), "rep"), plausible, earlier)
    pairs = few if crowded.isEmpty() else few.unionByName(_by_rare_shingles(placed.join(crowded, "key"), sets, brief, threshold, plausible))
    rest = storage.stage(pairs.distinct(), "further_pairs")
    links = storage.stage(links.union(_confirmed(rest, sets, threshold)), "all_links")
    final = components(links).withColumnRenamed("node", "rep")

    labelled = reps.join(final, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    blank = rows.filter("digest IS NULL").select("node", "n_shingles", F.col("node").alias("component"))
    filled = rows.filter("digest IS NOT NULL").join(labelled, "digest").select("node", "n_shingles", "component")
    joined = filled.unionByName(blank)
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return joined.select(
        real("node").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("node") == F.col("component")).alias("kept"), "node"
    ).drop("node")


def deduplicate(docs: DataFrame, width: int = 5, threshold: float = 0.8, text_col: str = "text") -> DataFrame:
    """One row of each group, the first as rows are numbered here, with all columns. Rows without words all stay."""
    names = docs.columns
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id())
    rows = storage.stage(numbered, "numbered")
    groups = near_duplicates(rows, width, threshold, "row", f"c{names.index(text_col)}")
    dropped = groups.filter("NOT kept").select(F.col("doc_id").alias("row"))
    return rows.join(dropped, "row", "left_anti").drop("row").toDF(*names)
