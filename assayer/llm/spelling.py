"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

1. Tasks count the words of whole texts; Spark adds the counts up. Rare words and short ones go.
2. A word is a point: how often it has each of LETTERS letter classes, and its length. One replaced code point moves a point
   by one step up and one step down at most, one inserted code point by one step up. Words of each pair of lengths (equal, or
   one apart) are therefore found by a range search that crosses a splitting plane at most once up and once down.
3. A k-d tree over a bounded sample of the words cuts the space in regions of about REGION words. Every word is a point of its
   one region and goes as a visitor to the later regions that the search reaches, in Spark rows; the cut is only a way to deal
   them out, no word is left to it.
4. In a region's task a second tree holds all its points down to leaves of LEAF; visitors and points search it, and what is
   close enough in letter counts is compared letter by letter.
5. Each word keeps the number of its near words and the largest of them; forms are followed to their last.

Null and empty texts have no words. A null id counts as an empty one where words are altered. Repeated rows count as often as
they occur. Ties between near words go to the smaller in code-point order. An empty table gives an empty result. Words may be
of any length: letters are compared in steps of bounded memory.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import storage, textarrays

#: Words have so many code points and occur so often; a form occurs so many times as often as its variant.
MIN_LENGTH, MIN_COUNT, FORM_RATIO = 7, 2, 10
#: One in ALTER_ONE_IN words (by a hash of document and word) loses a code point.
ALTER_ONE_IN = 31
#: a to z have a class each, all others share the rest.
LETTERS = 32
#: Words of a region, points of a leaf, and what the sample has for a region and at most in all.
REGION, LEAF, SAMPLE_PER_REGION, MAX_SAMPLE = 4096, 24, 24, 400_000
#: Distinct words that a task holds before it hands them on; cells of one step of comparing.
HELD_WORDS, CELLS = 400_000, 2_000_000

#: Of Latin-1 bytes: letters, A-Z in lower case, and blanks for all else.
_LETTERS_ONLY = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Runs of letters up to U+00FF, a byte for each; what Latin-1 doesn't have ends a run."""
    return text.encode("latin-1", "replace").translate(_LETTERS_ONLY).split()


def altered(run: bytes, doc: int) -> bytes:
    """The run, or what a typing error makes of it. doc: crc32 of the document's id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), doc)
    if h % ALTER_ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        words = list(held)
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part]), pa.array([held[w] for w in part], pa.int64())], ["word", "n"])

    for batch in batches:
        for a, b in textarrays.slices(batch.column(1)):
            part = batch.slice(a, b - a)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                doc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter([r for r in runs(text) if len(r) >= MIN_LENGTH]).items():
                    word = altered(run, doc)
                    if len(word) >= MIN_LENGTH:
                        held[word] += n
            if len(held) > HELD_WORDS:
                yield from rows()
                held.clear()
    yield from rows()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over whole texts, of all words that are long enough."""
    textarrays.ship_code(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(_count_task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """Code points of words, one after the other, and their points."""

    code: np.ndarray
    start: np.ndarray  # one more than words
    point: np.ndarray  # letter counts, then the length

    @classmethod
    def of(cls, words: list[str]) -> Words:
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where((code >= 97) & (code <= 122), code - 97, 26 + code % (LETTERS - 26)).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), size)
        counts = np.bincount(owner * LETTERS + kind, minlength=len(words) * LETTERS).reshape(len(words), LETTERS)
        return cls(code, np.concatenate(([0], np.cumsum(size))), np.column_stack([counts, size]).astype(np.int32))

    def letters(self, which: np.ndarray, length: int) -> np.ndarray:
        return self.code[self.start[which][:, None] + np.arange(length)]


@dataclass
class Tree:
    """A k-d tree. A node is (dimension, largest value on the left, left, right); a leaf is (-1, its number, 0, 0)."""

    nodes: list[tuple[int, int, int, int]]
    leaves: int

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> tuple[Tree, list[np.ndarray]]:
        """The tree and the rows of each leaf. Splits at the most balanced place; equal points stay together."""
        nodes: list = []
        rows: list[np.ndarray] = []

        def add(own: np.ndarray) -> int:
            at = len(nodes)
            nodes.append((-1, len(rows), 0, 0))
            cut = _cut(points[own]) if len(own) > leaf else None
            if cut is None:
                rows.append(own)
                return at
            left = points[own, cut[0]] <= cut[1]
            nodes[at] = (*cut, add(own[left]), add(own[~left]))
            return at

        add(np.arange(len(points)))
        return cls(nodes, len(rows)), rows

    def locate(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            at, own = stack.pop()
            dim, value, left, right = self.nodes[at]
            if dim < 0:
                out[own] = value
            elif len(own):
                below = points[own, dim] <= value
                stack += [(left, own[below]), (right, own[~below])]
        return out

    def search(self, points: np.ndarray, down: bool, visit: Callable[[int, np.ndarray], None]) -> None:
        """Calls visit(leaf, rows) where a point may lie that is one step up and, if `down`, one step down from a row's. Lengths must agree."""
        n = len(points)
        stack = [(0, np.arange(n), points, np.ones(n, bool), np.full(n, down))]
        while stack:
            at, own, point, may_rise, may_fall = stack.pop()
            dim, value, left, right = self.nodes[at]
            if not len(own):
                continue
            if dim < 0:
                visit(value, own)
                continue
            q = point[:, dim]
            falls = (q == value + 1) & may_fall & (dim < LETTERS)
            rises = (q == value) & may_rise & (dim < LETTERS)
            for side, stay, cross, step in ((left, q <= value, falls, -1), (right, q > value, rises, 1)):
                take = np.flatnonzero(stay | cross)
                crossing = cross[take]
                moved = point[take]
                moved[crossing, dim] += step
                rise, fall = may_rise[take], may_fall[take]
                if step > 0:
                    rise = rise & ~crossing
                else:
                    fall = fall & ~crossing
                stack.append((side, own[take], moved, rise, fall))


def _cut(points: np.ndarray) -> tuple[int, int] | None:
    """Dimension and value that split points most evenly; none if all are equal. A split by length is never crossed, so it counts double."""
    best, found = 0, None
    for dim in (LETTERS, *np.argsort(-points[:, :LETTERS].var(axis=0), kind="stable")[:4].tolist()):
        column = points[:, dim]
        value = int(np.median(column))
        for v in (value, value - 1):
            small = int((column <= v).sum())
            small = min(small, len(column) - small) * (2 if dim == LETTERS else 1)
            if small > best:
                best, found = small, (int(dim), v)
    return found


def one_edit(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b differ by one replaced code point (same length) or b has one more."""
    out = np.zeros(len(a), bool)
    size_a, size_b = words.point[a, LETTERS], words.point[b, LETTERS]
    for length in np.unique(size_b).tolist():
        for gap in (0, 1):
            all_rows = np.flatnonzero((size_b == length) & (size_a == length - gap))
            step = max(1, CELLS // max(length, 1))
            for i in range(0, len(all_rows), step):
                rows = all_rows[i : i + step]
                x, y = words.letters(a[rows], length - gap), words.letters(b[rows], length)
                if not gap:
                    out[rows] = (x != y).sum(axis=1) == 1
                else:
                    before = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
                    after = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                    out[rows] = before + after >= length - 1
    return out


def near_pairs(words: Words, points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) one edit apart, b among the rows in `points`, each pair once. kinds of rows: 0 a point of the region,
    1 a visitor for words of its length, 2 one for words one longer."""
    tree, leaves = Tree.build(words.point[points], LEAF)
    left, right = [], []

    def search(own: np.ndarray, longer: bool, inside: bool) -> None:
        query = words.point[own].copy()
        query[:, LETTERS] += longer

        def visit(leaf: int, rows: np.ndarray) -> None:
            there = points[leaves[leaf]]
            step = max(1, CELLS // (len(there) * LETTERS))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                away = np.abs(query[part][:, None, :LETTERS] - words.point[there][None, :, :LETTERS]).sum(axis=2)
                fits = (away <= (1 if longer else 2)) & (query[part][:, None, LETTERS] == words.point[there][None, :, LETTERS])
                if inside and not longer:  # both search: each pair once
                    fits &= own[part][:, None] < there[None, :]
                x, y = np.nonzero(fits)
                x, y = own[part][x], there[y]
                good = one_edit(words, x, y)
                left.append(x[good])
                right.append(y[good])

        tree.search(query, not longer, visit)

    search(points, False, True)
    search(points, True, True)
    search(np.flatnonzero(kinds == 1), False, False)
    search(np.flatnonzero(kinds == 2), True, False)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _deal(tree: Tree):
    """Rows (region, kind, word, n): a word as a point of its region and a visitor of others."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = Words.of(batch.column(0).to_pylist()).point
            home = tree.locate(points)
            region, row, kind = [home], [np.arange(len(points))], [np.zeros(len(points), np.int64)]

            def send(leaf: int, rows: np.ndarray, longer: bool) -> None:
                # the pair is found in the later of two regions if lengths are equal; a longer word's region is always visited
                rows = rows[home[rows] != leaf] if longer else rows[home[rows] < leaf]
                region.append(np.full(len(rows), leaf))
                row.append(rows)
                kind.append(np.full(len(rows), 2 if longer else 1))

            tree.search(points, True, lambda leaf, rows: send(leaf, rows, False))
            longer = points.copy()
            longer[:, LETTERS] += 1
            tree.search(longer, False, lambda leaf, rows: send(leaf, rows, True))
            taken = batch.take(pa.array(np.concatenate(row)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(region)), pa.array(np.concatenate(kind)), *taken.columns], ["region", "kind", "word", "n"])

    return work


def _best_in_region(table: pa.Table) -> pa.Table:
    """(word, n_near, form_n, form): of each word that has near words here, their number and the largest."""
    names, n = table["word"].to_pylist(), table["n"].to_numpy()
    kinds = table["kind"].to_numpy()
    points = np.flatnonzero(kinds == 0)
    a, b = near_pairs(Words.of(names), points, kinds) if len(points) else (np.zeros(0, np.int64),) * 2
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    place = np.argsort(np.array(names, object), kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[place] = np.arange(len(names))
    # a word may be here as a point and as a visitor of two kinds: its rows are told apart by row, and added up by Spark
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    count = np.diff(np.append(first, len(a)))
    best = b[first]
    word, form = table["word"].take(pa.array(a[first])), table["word"].take(pa.array(best))
    return pa.table({"word": word, "n_near": pa.array(count, pa.int64()), "form_n": pa.array(n[best], pa.int64()), "form": form})


def region_tree(words: DataFrame, region: int = REGION) -> Tree:
    """Cuts the space of letter counts by a sample of the words, those with the smallest hashes."""
    total = words.count()
    wanted = min(MAX_SAMPLE, max(1, total // region) * SAMPLE_PER_REGION)
    if total <= region:
        return Tree([(-1, 0, 0, 0)], 1)
    sample = [r.word for r in words.orderBy(F.xxhash64("word")).limit(wanted).select("word").collect()]
    return Tree.build(Words.of(sample).point, max(1, round(len(sample) * region / total)))[0]


def near_words(words: DataFrame, region: int = REGION) -> DataFrame:
    """(word, n_near, form_n, form): number of words one edit away, and the largest of them with its count."""
    tree = region_tree(words, region)
    dealt = words.select("word", "n").mapInArrow(_deal(tree), "region long, kind long, word string, n long")
    found = dealt.groupBy("region").applyInArrow(_best_in_region, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed until a word has none. Counts grow along a chain, so it ends."""
    forms = storage.stage(forms, "forms")
    following = forms.select(F.col("word").alias("at"), F.col("form").alias("next"))
    chains = storage.stage(forms.select("word", F.col("form").alias("at")), "chains")
    while True:
        step = chains.join(following, "at", "left").select("word", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("open"))
        step = storage.stage(step, "chains")
        if step.filter("open").isEmpty():
            return step.select("word", F.col("at").alias("root"))
        chains = step.drop("open")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", region: int = REGION) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word that is long and frequent enough."""
    textarrays.ship_code(docs.sparkSession)
    words = storage.stage(count_words(docs, id_col, text_col).filter(F.col("n") >= MIN_COUNT), "words")
    met = words.join(near_words(words, region), "word", "left")
    is_form = F.col("form_n") >= FORM_RATIO * F.col("n")
    formed = storage.stage(
        met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")),
        "formed",
    )
    ends = roots(formed.filter("form IS NOT NULL").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
