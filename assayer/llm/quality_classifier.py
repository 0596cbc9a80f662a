"""Quality classifier: perplexity under models of trusted text.

Interpolated modified Kneser-Ney models (see `ngram_model`), of byte 5-grams for spelling and of trigrams of word classes (see
`word_classes`) for the order of words, are trained on the distinct trusted texts of each language. Joins
with the model's shards give every document's perplexity. Its distance from the median of the language's trusted texts
counts less for short texts; a document passes if by both it is up to the QUANTILE of the trusted texts' distances. Median and quantile
come from held-out scores: trusted texts are dealt into FOLDS by a hash, and each is scored by a model of the other folds,
for a text that a model has seen is far easier for it than unseen text of the same kind. Copies of a text count once.

A language with fewer than MIN_TEXTS held-out scores takes the quantile over all languages' distances from their medians.
A null or empty text isn't kept. A text shorter than a gram has no perplexity, and a language without held-out scores (no
trusted text, or all of it in one fold) has no limit: what can't be judged is kept. A null language is "und". Repeated
rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import ngram_model, storage, word_classes

QUANTILE = 0.99
#: Parts of the trusted texts, at most 9; a model of all but one scores that one.
FOLDS = 4
#: Held-out scores that a language needs for a quantile of its own.
MIN_TEXTS = 20
#: Up to so many trusted ids, 8 bytes each, are broadcast, so that texts aren't shuffled to find them.
MAX_BROADCAST_IDS = 2_000_000
#: Stands before the language in the model of all folds; a fold's number in the model of the others.
ALL = "*"


def models(sample: DataFrame, folds: int = FOLDS) -> tuple[DataFrame, DataFrame]:
    """Model tables, by bytes and by word classes, of all (fold, lang, text) rows and of all but one fold for each fold; counted
    once for each fold."""
    if not 2 <= folds <= 9:
        raise ValueError("2 to 9 folds")  # a fold is one character of the model's language
    marked = sample.select(F.concat_ws("|", "fold", "lang").alias("lang"), "text")
    rows = ngram_model.gram_rows(marked, kinds=word_classes.BOTH).withColumn("by_class", F.col("lang").startswith(word_classes.MARK))
    rows = rows.withColumn("lang", F.expr("if(by_class, substring(lang, 2), lang)"))
    rows = rows.select("by_class", F.expr("substring(lang, 3)").alias("plain"), "gram", F.ascii("lang").alias("fold"), "n")
    of_fold = [F.sum(F.when(F.col("fold") == ord(str(f)), F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(folds)]
    counted = storage.stage(rows.groupBy("by_class", "plain", "gram").agg(*of_fold), "fold_grams")
    return ngram_model.estimate(_all_but_one(counted.filter("NOT by_class"), folds)), ngram_model.estimate(_all_but_one(counted.filter("by_class"), folds), word_classes.ORDER)


def _all_but_one(counts: DataFrame, folds: int) -> DataFrame:
    every = sum(F.col(f"n{f}") for f in range(folds))
    outs = [(ALL, every), *[(str(f), every - F.col(f"n{f}")) for f in range(folds)]]
    out = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), n.alias("n")) for name, n in outs])).alias("out")
    return counts.select("plain", "gram", out).filter("out.n > 0").select(F.concat_ws("|", "out.name", "plain").alias("lang"), "gram", F.col("out.n").alias("n"))


def held_out_limits(held: DataFrame, quantile: float = QUANTILE, full: int = ngram_model.FULL_GRAMS) -> DataFrame:
    """(lang, median, limit): one row for each language that has held-out scores."""
    held = held.filter("perplexity IS NOT NULL")
    middle = held.groupBy("lang").agg(F.percentile_approx(F.log("perplexity"), 0.5, 10_000).alias("median"))
    away = held.join(F.broadcast(middle), "lang").withColumn("deviation", ngram_model.deviation(F.col("perplexity"), F.col("median"), F.col("grams"), full))
    end = F.percentile_approx("deviation", quantile, 10_000)
    over_all = away.agg(end.alias("over_all"))
    own = away.groupBy("lang").agg(F.first("median").alias("median"), end.alias("own"), F.count("*").alias("n"))
    limit = F.when(F.col("n") >= MIN_TEXTS, F.col("own")).otherwise(F.col("over_all"))
    return own.crossJoin(F.broadcast(over_all)).select("lang", "median", limit.alias("limit"))


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, deviation, limit, kept) of each document. trusted: a column of ids; null ids are ignored."""
    ids = trusted.select(trusted.columns[0]).toDF("_trusted").filter("_trusted IS NOT NULL").distinct()
    ids = storage.stage(ids, "trusted_ids")
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    named = docs.select(F.col(id_col).alias("doc_id"), ngram_model.language(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text"))
    named = named.withColumn("filled", F.coalesce(F.col("text"), F.lit("")) != "")
    sample = ngram_model.distinct_texts(named.join(ids, named.doc_id == ids._trusted, "left_semi").filter("filled"))
    sample = storage.stage(sample.select(F.pmod(F.crc32("text_key"), F.lit(FOLDS)).cast("string").alias("fold"), "lang", "text"), "trusted_texts")
    model, class_model = models(sample)
    plain = F.expr("substring(lang, 3)").alias("lang")
    of_all = lambda table: table.filter(F.col("lang").startswith(ALL)).select(plain, "kind", "size", "gram", "value")
    of_folds = lambda table: table.filter(~F.col("lang").startswith(ALL))
    more = _by_class(of_all(class_model))
    scored = storage.stage(ngram_model.score(named, of_all(model), ["doc_id", "lang", "filled"], extra=more), "scored")
    marked = sample.select(F.concat_ws("|", "fold", "lang").alias("lang"), "text")
    held = ngram_model.score(marked, of_folds(model), ["lang"], extra=_by_class(of_folds(class_model))).withColumn("lang", plain)
    held = storage.stage(held, "held_out")
    by_bytes = judged_by(scored, held_out_limits(held, quantile))
    as_plain = {c: c.removeprefix("class_") for c in word_classes.FIELDS}
    limits = held_out_limits(held.drop("perplexity", "grams").withColumnsRenamed(as_plain), quantile, word_classes.FULL_GRAMS)
    set_by = {c: f"byte_{c}" for c in ("perplexity", "grams", "deviation", "limit", "fits")}
    both = judged_by(by_bytes.withColumnsRenamed(set_by).withColumnsRenamed(as_plain), limits, word_classes.FULL_GRAMS)
    kept = F.col("filled") & F.col("byte_fits") & F.col("fits")
    names = [F.col(f"byte_{c}").alias(c) for c in ("perplexity", "deviation", "limit")] + [F.col(c).alias(f"class_{c}") for c in ("perplexity", "deviation", "limit")]
    return both.select("doc_id", "lang", *names, kept.alias("kept"))


def _by_class(model: DataFrame) -> ngram_model.Extra:
    return ngram_model.Extra(word_classes.FIELDS, word_classes.scorer(ngram_model.whole_model(model, word_classes.ORDER)))


def judged_by(scored: DataFrame, limits: DataFrame, full: int = ngram_model.FULL_GRAMS) -> DataFrame:
    """With deviation, limit and whether the document fits; what can't be judged does."""
    joined = scored.join(F.broadcast(limits), "lang", "left")
    judged = joined.withColumn("deviation", ngram_model.deviation(F.col("perplexity"), F.col("median"), F.col("grams"), full)).drop("median")
    return judged.withColumn("fits", F.coalesce(F.col("deviation") <= F.col("limit"), F.lit(True)))
