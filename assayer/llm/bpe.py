"""Byte-level BPE: backtracking encoder in linear time, and a decoder by offset table.

The encoder takes the longest token at each place of a piece (Aho-Corasick gives all matches in one pass). A token may
follow another only if undoing the merges of both never shows a merge across their border that would have come first
(the pair-compatibility table, filled as pairs are met). Where nothing fits, it goes back one token and bars that border;
each border is barred at most once. The result equals merging by rank.

Null text is empty text: no tokens, decoded text "". Any text is taken whole; strings of special tokens become their ids.
Repeated rows are encoded alike. Columns other than those asked for aren't read. Bytes that aren't UTF-8 after decoding
single tokens become U+FFFD, as in other decoders.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from assayer.llm import textarrays

#: White space of the split before merging, and the endings it cuts off after an apostrophe.
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Pieces kept with their ids, twice at most; longer pieces aren't kept.
KEPT_PIECES, KEPT_BYTES, KEPT_PAIRS = 150_000, 48, 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def char_classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 anything else."""
    kinds = np.full(0x110000, 3, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    kinds[list(WHITE)] = 0
    return kinds


def piece_starts(code: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces start in code points of texts that stand one after the other; `begins` marks the texts' first.

    A piece is a run of letters, of numbers or of other signs with one blank before it, or a run of white space less that
    blank; white space before a sign leaves its last character apart. An ending after a lone apostrophe goes with it.
    """
    kind = char_classes()[code]
    last = np.append(begins[1:], True)  # of its text
    edge = begins.copy()
    edge[1:] |= kind[1:] != kind[:-1]
    joined = np.zeros(len(code), bool)  # to the blank before it
    joined[1:] = edge[1:] & ~begins[1:] & (code[:-1] == 32) & (kind[1:] != 0)
    before_sign = (kind == 0) & ~last & np.append(kind[1:] != 0, False)
    starts = (edge & ~joined) | before_sign
    for i in np.flatnonzero(starts & (code == 39) & ~last & np.append(kind[1:] == 1, False)).tolist():
        follow = "".join(chr(c) for c, end in zip(code[i + 1 : i + 3].tolist(), (False, last[i + 1]), strict=False) if not end)
        ending = next((e for e in ENDINGS if follow.startswith(e)), "")
        if ending:
            starts[i + 1] = False
            if not last[i + len(ending)]:
                starts[i + 1 + len(ending)] = True
    return starts


def unlike(data: np.ndarray, low: np.ndarray, high: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which stretches differ in a byte from the stretch that stands for them, though their hashes are equal."""
    size = high - low
    out = size != size[other]
    rows = np.flatnonzero(~out & (other != np.arange(len(low))))
    stop = np.cumsum(size[rows])
    if len(rows):
        step = np.arange(stop[-1])
        back = stop - size[rows]
        differs = data[np.repeat(low[rows] - back, size[rows]) + step] != data[np.repeat(low[other[rows]] - back, size[rows]) + step]
        if differs.any():
            out[rows[np.searchsorted(stop, np.flatnonzero(differs), "right")]] = True
    return np.flatnonzero(out)


class Codec:
    """Tables of one vocabulary file. Inside, a token's number is its rank: bytes first, then merges in order."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        symbols = {b: c for c, b in alphabet.items()}
        names = [symbols[b] for b in range(256)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        names += [a + b for a, b in merges]
        rank = {name: i for i, name in enumerate(names)}
        if len(rank) != len(names):
            raise ValueError("two merges make the same token")
        self.left = [*range(256), *(rank[a] for a, _ in merges)]
        self.right = [*range(256), *(rank[b] for _, b in merges)]
        self.merge = {(self.left[i], self.right[i]): i for i in range(256, len(names))}
        self.bytes = [raw(name) for name in names]
        self.ids = [vocab[name] for name in names]
        self.size = [len(b) for b in self.bytes]
        known = {b: i for i, b in enumerate(self.bytes)}
        self.prefix = [next((known[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in known), -1) for b in self.bytes]
        self.matches = ahocorasick.Automaton()
        for i, b in enumerate(self.bytes):
            self.matches.add_word(b.decode("latin-1"), (i, len(b) - 1))
        self.matches.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.new: dict[bytes, tuple[int, ...]] = {}
        self.old: dict[bytes, tuple[int, ...]] = {}
        by_id = dict(zip(self.ids, self.bytes, strict=True)) | {i: t.encode() for t, i in self.special.items()}
        table = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(b) for b in table], dtype=np.int64)))

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank can leave a and b side by side."""
        if (kept := self.pairs.get((a, b))) is not None:
            return kept
        key, bound, fits = (a, b), len(self.bytes), True
        while True:
            made = self.merge.get((a, b))
            if made is not None and made < bound:
                fits = False
                break
            if a > b:  # undo the later of the two merges
                if a < 256:
                    break
                bound, a = a, self.right[a]
            else:
                if b < 256:
                    break
                bound, b = b + 1, self.left[b]  # on a tie the merge further left comes first
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[key] = fits
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [0] * n
        for end, (token, reach) in self.matches.iter(piece.decode("latin-1")):
            longest[end - reach] = token  # ends come in order, so the longest is last
        barred = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + self.size[token]
            if not barred[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            elif self.prefix[token] >= 0:
                token = self.prefix[token]
            else:
                barred[at] = 1
                token = out.pop()
                at -= self.size[token]

    def ids_of(self, piece: bytes) -> tuple[int, ...]:
        found = self.new.get(piece) or self.old.get(piece)
        if found is None and (mark := piece.decode("utf-8", "replace")) in self.special:
            found = (self.special[mark],)
        if found is None:
            found = tuple([self.ids[t] for t in self.encode_piece(piece)])
            if len(piece) > KEPT_BYTES:
                return found
        if len(self.new) >= KEPT_PIECES:
            self.old, self.new = self.new, {}
        self.new[piece] = found
        return found

    def segments(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """Texts cut at the strings of special tokens, and where each text's last part ends."""
        if not any(mark in text for text in texts for mark in self.special):
            return texts, list(range(1, len(texts) + 1))
        parts, ends = [], []
        for text in texts:
            parts += self.split.split(text)
            ends.append(len(parts))
        return parts, ends

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids end."""
        parts, ends = self.segments(texts)
        joined = "".join(parts)
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cuts = np.cumsum([0, *map(len, parts)])
        begins = np.zeros(len(code) + 1, bool)
        begins[cuts] = True
        starts = piece_starts(code, begins[:-1])
        if len(parts) != len(texts):
            for i in np.flatnonzero([p in self.special for p in parts]).tolist():
                starts[cuts[i] + 1 : cuts[i + 1]] = False
        raw = joined.encode("utf-8", "surrogatepass")
        first = np.flatnonzero(starts)
        at = np.concatenate(([0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), dtype=np.int64)))
        low, high = at[first], np.append(at[first[1:]], len(raw))
        data = np.frombuffer(raw, np.uint8)
        _, sample, which = np.unique(textarrays.span_hash(data, low, high), return_index=True, return_inverse=True)
        apart = unlike(data, low, high, sample[which])
        which[apart] = len(sample) + np.arange(len(apart))
        sample = np.concatenate([sample, apart])
        pieces = [raw[a:b] for a, b in zip(low[sample].tolist(), high[sample].tolist(), strict=True)]
        found = list(map(self.new.get, pieces))
        found = [self.ids_of(p) if f is None else f for p, f in zip(pieces, found, strict=True)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        begin = np.cumsum(size) - size
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))
        size, begin = size[which], begin[which]
        stop = np.cumsum(size)
        ids = flat[np.repeat(begin - (stop - size), size) + np.arange(stop[-1])]
        upto = np.concatenate(([0], stop))
        return ids, upto[np.searchsorted(first, cuts[ends])]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of several lists of ids that stand one after the other."""
        size = self.offsets[ids + 1] - self.offsets[ids]
        stop = np.concatenate(([0], np.cumsum(size)))
        data = self.blob[np.repeat(self.offsets[ids] - stop[:-1], size) + np.arange(stop[-1])].tobytes()
        cuts = stop[np.concatenate(([0], ends))].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: Iterable[int]) -> str:
        listed = np.fromiter(ids, np.int64)
        return self.decode_all(listed, np.array([len(listed)]))[0]


@functools.lru_cache(2)
def codec(vocabulary: bytes) -> Codec:
    return Codec(vocabulary)


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, `ids` and the text `decoded` from the ids. vocabulary: path of the file, read once by the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        tables = codec(shared.value)
        ids, ends = tables.encode_all(texts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
        kept = [batch.column(i) for i in range(len(keep))]
        return pa.RecordBatch.from_arrays([*kept, lists, pa.array(tables.decode_all(ids, ends))], [*keep, "ids", "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", ids array<int>, decoded string"
    named = docs.select(*keep, docs[text_col].alias("_text"))
    return textarrays.map_texts(named, work, "_text", schema)
