"""Texts of an Arrow batch as byte and word arrays: the vectorised groundwork of the operators that need Python.

All of it works on a slice of about SLICE_BYTES of text; a longer text is a slice of its own and stays whole.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
_U = np.uint64
#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Primes below 2**31 with a base each; bytes times powers add up exactly over so many bytes.
_PRIMES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_017))
_EXACT = 1 << 24

#: White space that splits words.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: All of ASCII but letters and digits.
NOT_ALNUM = bytes(b for b in range(0x80) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    step = (np.cumsum(size) - 1).clip(0) // limit
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(size)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each application; Spark hands the file on to the executors."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='assayer-')}/assayer_code", "zip", root, "assayer")
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def map_texts(docs: DataFrame, work: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch], text: str, schema) -> DataFrame:
    """mapInArrow by slices; work gets a slice of the rows and its texts."""
    ship_code(docs.sparkSession)
    return docs.mapInArrow(map_slices(work, text), schema)


def map_rows(docs: DataFrame, work: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch], text: str, added: dict[str, str] | None = None) -> DataFrame:
    """map_texts over all columns, whatever their names: work sees them by position, and further ones come after them."""
    names, extra = docs.columns, added or {}
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema] + [f"a{i} {kind}" for i, kind in enumerate(extra.values())]
    return map_texts(plain, work, f"c{names.index(text)}", ", ".join(fields)).toDF(*names, *extra)


def map_slices(work: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch], text: str) -> Callable:
    """For mapInArrow: hands on slices of the batches with their texts (null: empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in slices(column):
                part = batch.slice(a, b - a)
                yield work(part, [t or "" for t in column.slice(a, b - a).to_pylist()])

    return run


def group_starts(group: np.ndarray, groups: int) -> np.ndarray:
    """Of sorted group numbers: where each of the groups begins, and the end."""
    return np.searchsorted(group, np.arange(groups + 1))


@dataclass
class Bytes:
    """UTF-8 bytes of texts, each followed by a line end that isn't part of it."""

    data: np.ndarray
    starts: np.ndarray  # one more than texts

    @classmethod
    def of(cls, texts: list[str]) -> Bytes:
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        return cls(data, np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts], dtype=np.int64))))

    def __len__(self) -> int:
        return len(self.starts) - 1


@dataclass
class Spans:
    """Words or lines: text number, first byte, byte after the last, 64-bit hash of the bytes."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _prime_powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate([out, out * _U(pow(base, len(out), prime)) % _U(prime)])
    return out[:n]


_tables: dict[tuple, np.ndarray] = {}


def _table(make: Callable[..., np.ndarray], *of: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 at least; kept up to the size of a usual slice."""
    if n > 4 * SLICE_BYTES:
        return make(*of, n)
    if of not in _tables or len(_tables[of]) < n:
        _tables[of] = make(*of, max(n, SLICE_BYTES * 5 // 4))
    return _tables[of]


def rolling_hash(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all stretches of `width` bytes, a polynomial modulo 2**64: for a few hundred bytes at most, as long words can be
    made to collide under it."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    up, down = _table(_powers, _BASE, n=len(data)), _table(_powers, _INVERSE, n=len(data))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(data * up[: len(data)], out=sums[1:], dtype=_U)
    return mix((sums[width:] - sums[:n]) * down[:n])


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes, from a running sum over all of them: polynomials modulo two primes.

    Sums of up to _EXACT bytes are exact whole numbers before they are reduced; longer stretches are added up in parts."""
    if not len(start):
        return np.zeros(0, _U)
    value = (end - start).astype(_U) * _U(0xD6E8FEB86659FD93)
    parts = int((end - start).max()) // _EXACT + 1
    for prime, base in _PRIMES:
        up, down = _table(_prime_powers, base, prime, n=len(data)), _table(_prime_powers, pow(base, -1, prime), prime, n=len(data))
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(data * up[: len(data)], out=sums[1:], dtype=_U)
        total = np.zeros(len(start), _U)
        for j in range(parts):
            low, high = (np.minimum(start + i * _EXACT, end) for i in (j, j + 1))
            total += (sums[high] - sums[low]) % _U(prime)
        value = mix(value + total % _U(prime) * down[start] % _U(prime))
    return value


def short_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """span_hash of stretches of a few bytes, without sums over all bytes."""
    length = end - start
    value = length.astype(_U) * _U(0xD6E8FEB86659FD93)
    for prime, base in _PRIMES:
        total = np.zeros(len(start), _U)
        for j in range(int(length.max(initial=0))):
            on = np.flatnonzero(length > j)
            total[on] += data[start[on] + j] * _U(pow(base, j, prime))
        value = mix(value + total % _U(prime))
    return value


def spans(texts: Bytes, separators: bytes, lower: bool = False) -> Spans:
    """Runs of bytes other than the separators, in order."""
    data = _LOWER[texts.data] if lower else texts.data
    text, start, end = runs(texts, data, separators)
    return Spans(text, start, end, span_hash(data, start, end))


def runs(texts: Bytes, data: np.ndarray, separators: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first byte and byte after the last of the spans, without a hash."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    inside[10] = False  # also what keeps the texts apart
    edges = np.diff(inside[data].astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return np.searchsorted(texts.starts, start, "right") - 1, start, end


def windows(words: Spans, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of each window of `width` words within one text."""
    n = len(words.hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    value = words.hash[:n].copy()
    for j in range(1, width):
        value = value * _U(_BASE) + words.hash[j : j + n]
    first = np.flatnonzero(words.text[:n] == words.text[width - 1 :])
    return first, mix(value[first])
