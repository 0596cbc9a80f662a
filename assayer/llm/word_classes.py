"""N-grams of word classes: what byte n-grams, which end within a word or two, can't see, the order of words.

A word is one of CLASSES: short words in small letters (most are articles, prepositions, conjunctions) by their letters, longer
ones by a capital at the start and by length, each with what punctuation it ends in. Shuffled words put capitals behind commas
and articles before full stops, which trigrams of classes find improbable. With so few classes a model has a proven bound of
CLASSES**3 grams for a language, so all of it is broadcast.

Null or empty texts, and texts of fewer than ORDER words, have no grams and a null perplexity.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast

from assayer.llm import ngram_model, textarrays

ORDER = 3
#: Classes by letters, and all of them: no letter first, short, short with a capital, three lengths each with and without; times three endings.
SHORT, BASES = 12, 21
CLASSES = 3 * BASES
#: Grams from which on a perplexity counts in full.
FULL_GRAMS = 300
#: Stands before the language of class grams where byte grams are counted in the same pass.
MARK = "\x01"

_ENDING = np.zeros(256, np.uint8)
_ENDING[list(b",;:")] = 1
_ENDING[list(b".!?")] = 2


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and class of each word."""
    flat = textarrays.Bytes.of(texts)
    owner, start, end = textarrays.runs(flat, flat.data, textarrays.SPACES)
    data = np.append(flat.data, 0)
    ending = _ENDING[data[end - 1]] if len(end) else np.zeros(0, np.uint8)
    end = end - (ending > 0)
    first, second = data[start], data[start + 1]
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    letter = capital | ((first >= 97) & (first <= 122)) | (first >= 0x80)
    heads = np.concatenate(([0], np.cumsum((flat.data & 0xC0) != 0x80)))
    length = heads[end] - heads[start]
    by_length = (length > 5).astype(np.int64) + (length > 8)
    base = np.where(length <= 3, SHORT + 1, np.where(capital, SHORT + 2, SHORT + 5) + by_length)
    short = np.flatnonzero((length <= 3) & ~capital)
    base[short] = 1 + (textarrays.short_hash(flat.data, start[short], end[short]) % np.uint64(SHORT)).astype(np.int64)
    return owner, ending * BASES + np.where(letter & (length > 0), base, 0)


def class_grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Text number and gram of each window of `order` words within one text, as `ngram_model.byte_grams` has them of bytes."""
    text, value = classes(texts)
    n = len(value) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = np.zeros(n, np.uint64)
    for j in range(order):
        gram = (gram << np.uint64(8)) | value[j : j + n].astype(np.uint64)
    whole = text[:n] == text[order - 1 :]
    return text[:n][whole], gram[whole]


def scorer(shared: list[Broadcast]):
    """For `ngram_model.Extra`: (texts, languages) -> [perplexity per word, number of grams] under a model's broadcast shards."""

    def work(texts: list[str], langs: list[str]) -> list[np.ndarray]:
        shards = [s.value for s in shared]
        names = np.array(langs, object)
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for lang in set(langs):
            if lang in shards[0].langs:
                rows = np.flatnonzero(names == lang)
                text, gram = class_grams([texts[i] for i in rows.tolist()], ORDER)
                total[rows], n[rows] = ngram_model.text_sums(shards, lang, text, gram, len(rows))
        perplexity = [float(np.exp(-t / k)) if k else None for t, k in zip(total.tolist(), n.tolist(), strict=True)]
        return [perplexity, n]

    return work


FIELDS = {"class_perplexity": "double", "class_grams": "long"}
#: What `ngram_model.count_grams` counts in one pass: byte grams, and class grams under marked languages.
BOTH = {"": (ngram_model.byte_grams, ngram_model.ORDER), MARK: (class_grams, ORDER)}
