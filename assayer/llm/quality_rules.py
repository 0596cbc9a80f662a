"""Quality rules: counts over words and lines, then the perplexity bands of the document's language.

There are two models: of byte 5-grams, which judge spelling, and of trigrams of word classes (see `word_classes`), which judge the
order of words; a document has to lie in the bands of both. A model (see `ngram_model`) is counted over all texts that pass the counting rules and have few symbols, so it stays
surprised by what the others are made of. The band of a language reaches FENCES quartile distances below the first and above
the third quartile of those texts' log perplexity, which counts less for short texts; what lies outside is rejected. Model,
median and quartiles take each text of a language once, so copies don't move them. A language with fewer than MIN_TEXTS
such texts, or without any distance between its quartiles, takes the band over the texts of all languages, each held
against the median of its own.

Words are runs of anything but white space. Null or empty text has no words and fails. Documents without a perplexity
fail the counting rules by their length. Repeated rows are judged alike, each on its own row. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import ngram_model, storage, textarrays, word_classes

#: Fixed values of the counting rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = b"#*$%&|<>"
#: Symbols for a word that a document in the model has at most.
MODEL_SYMBOLS = 0.1
#: Quartile distances that a band reaches below and above the quartiles. Texts that share passages are easy for the model
#: without being bad, so the lower end is further away.
FENCES = (6.0, 3.0)
#: The same for perplexity by word classes.
CLASS_FENCES = (6.0, 2.0)
#: Distinct texts that a language needs for a band of its own.
MIN_TEXTS = 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_counts(texts: list[str]) -> list[np.ndarray]:
    """The COUNTS of each text."""
    flat = textarrays.Bytes.of(texts)
    m = len(texts)
    words, lines = _words_and_lines(flat)
    n_words = np.bincount(words.text, minlength=m)
    upto = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    heads = upto((flat.data & 0xC0) != 0x80)
    chars = np.bincount(words.text, heads[words.end] - heads[words.start], m).astype(np.int64)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    n_symbols = np.diff(np.searchsorted(np.flatnonzero(is_symbol[flat.data]), flat.starts))
    filled = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    text, value = lines.text[filled], lines.hash[filled]
    order = np.lexsort((value, text))
    again = (np.diff(text[order]) == 0) & (value[order][1:] == value[order][:-1])
    n_dup = np.bincount(text[order][1:][again], minlength=m)
    return [n_words, chars, n_symbols, n_dup, _repeated(words, m)]


def _words_and_lines(flat: textarrays.Bytes) -> list[textarrays.Spans]:
    """Their hashes from one sum over the bytes."""
    both = [textarrays.runs(flat, flat.data, by) for by in (textarrays.SPACES, b"\n")]
    value = textarrays.span_hash(flat.data, *(np.concatenate([b[i] for b in both]) for i in (1, 2)))
    cut = len(both[0][0])
    return [textarrays.Spans(*b, v) for b, v in zip(both, (value[:cut], value[cut:]), strict=True)]


def _repeated(words: textarrays.Spans, m: int) -> np.ndarray:
    """Words in windows that a text has at least twice."""
    first, value = textarrays.windows(words, WINDOW)
    text = words.text[first]
    order = np.lexsort((value, text))
    same = (np.diff(text[order]) == 0) & (value[order][1:] == value[order][:-1])
    twice = np.zeros(len(order) + 1, bool)
    twice[1:-1] = same
    hot = np.zeros(len(order), bool)
    hot[order] = twice[1:] | twice[:-1]
    covered = np.zeros(len(words.text), bool)
    for j in range(WINDOW):
        covered[first[hot] + j] = True
    return np.bincount(words.text[covered], minlength=m)


def _columns(texts: list[str]) -> list[np.ndarray]:
    return [c.astype(np.int64) for c in text_counts(texts)]


def _for_model(texts: list[str]) -> np.ndarray:
    """Marks texts that pass the counting rules and have few symbols."""
    n, _, symbols, _, repeats = _columns(texts)
    return (n >= MIN_WORDS) & (100 * repeats <= MAX_REPEAT_PERCENT * n) & (symbols <= MODEL_SYMBOLS * n)


def in_model(scored: DataFrame) -> DataFrame:
    return scored.filter(~F.col("base_failed") & (F.col("n_symbols") <= MODEL_SYMBOLS * F.col("n_words")))


def with_bands(scored: DataFrame, fences: tuple[float, float] = FENCES, full: int = ngram_model.FULL_GRAMS) -> DataFrame:
    """With deviation, low and high: the band of a language is one row, made from the distinct texts in the model."""
    once = in_model(scored).groupBy("lang", "text_key").agg(F.first("perplexity").alias("perplexity"), F.first("grams").alias("grams"))
    once = storage.stage(once, "distinct_scores")
    middle = F.broadcast(once.groupBy("lang").agg(F.percentile_approx(F.log("perplexity"), 0.5, 10_000).alias("median")))
    distance = ngram_model.deviation(F.col("perplexity"), F.col("median"), F.col("grams"), full)
    away = once.join(middle, "lang").withColumn("deviation", distance)
    quartiles = F.percentile_approx("deviation", [0.25, 0.75], 10_000)
    own = away.groupBy("lang").agg(quartiles.alias("own"), F.count("*").alias("n"))
    enough = (F.col("n") >= MIN_TEXTS) & (F.col("own")[1] > F.col("own")[0])
    bands = own.crossJoin(F.broadcast(away.agg(quartiles.alias("over_all")))).withColumn("q", F.when(enough, F.col("own")).otherwise(F.col("over_all")))
    spread = F.col("q")[1] - F.col("q")[0]
    ends = bands.select("lang", (F.col("q")[0] - fences[0] * spread).alias("low"), (F.col("q")[1] + fences[1] * spread).alias("high"))
    return scored.join(middle, "lang", "left").withColumn("deviation", distance).join(F.broadcast(ends), "lang", "left").drop("median")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = (), fences: tuple[float, float] = FENCES, class_fences: tuple[float, float] = CLASS_FENCES) -> DataFrame:
    """One row per document: id, counts, base_failed, perplexity, deviation and band by bytes and (class_...) by word classes, and kept;
    columns in `keep` go along as c0, c1, ..."""
    named = docs.select(
        F.col(id_col).alias("doc_id"), ngram_model.language(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text"),
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)],
    )
    named = named.withColumn("text_key", F.unhex(F.md5("text")))
    counted = ngram_model.count_grams(ngram_model.distinct_texts(named), accept=_for_model, kinds=word_classes.BOTH)
    counted = storage.stage(counted, "gram_counts")
    marked = F.col("lang").startswith(word_classes.MARK)
    model = ngram_model.estimate(counted.filter(~marked))
    of_classes = ngram_model.estimate(counted.filter(marked).withColumn("lang", F.expr("substring(lang, 2)")), word_classes.ORDER)
    by_class = word_classes.scorer(ngram_model.whole_model(of_classes, word_classes.ORDER))
    columns = ["doc_id", "lang", "text_key", *(f"c{i}" for i in range(len(keep)))]
    more = ngram_model.Extra(dict.fromkeys(COUNTS, "long") | word_classes.FIELDS, lambda texts, langs: [*_columns(texts), *by_class(texts, langs)])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = storage.stage(ngram_model.score(named, model, columns, extra=more).withColumn("base_failed", failed), "scored")
    inside = F.coalesce(F.col("deviation").between(F.col("low"), F.col("high")), F.lit(False))
    banded = with_bands(scored, fences).withColumn("in_band", inside).withColumnsRenamed({c: f"byte_{c}" for c in ("perplexity", "grams", "deviation", "low", "high")})
    banded = banded.withColumnsRenamed({c: c.removeprefix("class_") for c in word_classes.FIELDS})
    both = with_bands(banded, class_fences, word_classes.FULL_GRAMS).withColumn("in_band", F.col("in_band") & inside)
    both = both.withColumnsRenamed({c: f"class_{c}" for c in ("perplexity", "grams", "deviation", "low", "high")})
    both = both.withColumnsRenamed({f"byte_{c}": c for c in ("perplexity", "grams", "deviation", "low", "high")})
    return both.withColumn("kept", ~F.col("base_failed") & F.col("in_band")).drop("text_key", "in_band")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", fences: tuple[float, float] = FENCES) -> DataFrame:
    """The documents that are kept, with all columns as they are."""
    names = docs.columns
    plain = docs.toDF(*[f"p{i}" for i in range(len(names))])
    at = lambda name: f"p{names.index(name)}"
    judged = judge(plain, at(text_col), at(text_col), at(lang_col), tuple(c for c in plain.columns if c != at(text_col)), fences)
    order = iter(range(len(names)))
    columns = ["doc_id" if c == at(text_col) else f"c{next(order)}" for c in plain.columns]
    return judged.filter("kept").select(*columns).toDF(*names)
