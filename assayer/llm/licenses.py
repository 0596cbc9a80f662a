"""License scan by diagonal voting, in DataFrame functions only.

All rolling word k-gram hashes of a text are joined to the positions of the same hashes in the templates. A hit votes for
the diagonal text position - template position; neighbouring diagonals (words put in or left out) are merged; the words of
a diagonal are then compared one by one with the template, and a label holds where enough of the template is covered.

Words: text in lower case, runs of ASCII letters and digits and of characters beyond ASCII. Null text is empty text: no
words, no labels, score 0. Repeated rows (same id and text) each get the same result. A tie between labels keeps both.
Columns other than id and text aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a hashed gram.
GRAM = 3
#: Diagonals at most this far apart are merged.
MAX_SHIFT = 3
#: Share of a template's words that a span must cover.
MIN_COVER = 0.8

#: Phrases that name a license by themselves.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Sentences of public license notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)



def _lower(text: Column) -> Column:
    """Lower case that makes ASCII letters of A-Z only: the two characters beyond ASCII that would become some change to another first."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u212b")), F.lit("\u0130"), F.lit("\u212b")))


def words(text: Column) -> Column:
    return F.filter(F.split(_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def grams(tokens: Column, k: int) -> Column:
    """Hashes of all k-word windows, by start."""
    last = F.size(tokens) - k
    hashed = lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(k)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), hashed)).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...], k: int) -> DataFrame:
    """(gram, template_pos, template number, label, template words): a fixed list, as long as the templates are."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("notice"))
        for n, (label, text) in enumerate(templates)
    ])
    listed = spark.range(1).select(F.inline(rows)).withColumn("pattern", F.split("notice", " "))
    return listed.select("template", "label", "pattern", F.posexplode(grams(F.col("pattern"), k)).alias("template_pos", "gram"))


def _key(id_col: str, text_col: str) -> Column:
    """Same id and text, same key; the result of such rows is the same."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit(""))))


def license_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    k: int = GRAM,
    max_shift: int = MAX_SHIFT,
    min_cover: float = MIN_COVER,
) -> DataFrame:
    """Verified spans: (doc_key, doc_id, label, template, first_word, last_word, votes, cover)."""
    tokens = docs.select(_key(id_col, text_col).alias("doc_key"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    positions = tokens.withColumn("grams", grams(F.col("words"), k)).select("*", F.posexplode_outer("grams").alias("pos", "gram"))
    known = F.broadcast(template_grams(docs.sparkSession, templates, k))
    offset = F.col("pos") - F.col("template_pos")
    size = F.size("pattern")
    aligned = F.slice("words", F.greatest(offset, F.lit(0)) + 1, size + F.least(offset, F.lit(0)))
    hits = positions.join(known, "gram").select(
        "doc_key", "doc_id", "template", "label", "pattern", "template_pos", offset.alias("diagonal"), aligned.alias("aligned")
    )
    votes = hits.groupBy("doc_key", "template", "diagonal").agg(
        F.first("doc_id").alias("doc_id"), F.first("label").alias("label"), F.first("pattern").alias("pattern"),
        F.first("aligned").alias("aligned"), F.count_distinct("template_pos").alias("votes"),
    )
    skipped = F.greatest(-F.col("diagonal"), F.lit(0))  # template words before the text begins
    agrees = lambda i: F.get("aligned", i - skipped) == F.get("pattern", i)
    along = votes.withColumn("covered", F.filter(F.sequence(F.lit(0), size - 1), agrees)).select(
        "doc_key", "doc_id", "template", "label", "diagonal", "votes", "covered", size.alias("length"),
        (F.col("diagonal") + F.array_min("covered")).alias("first_word"), (F.col("diagonal") + F.array_max("covered")).alias("last_word"),
    )
    order = Window.partitionBy("doc_key", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal", 1).over(order) > max_shift).cast("int")
    chained = along.withColumn("fresh", F.coalesce(fresh, F.lit(0))).withColumn("chain", F.sum("fresh").over(order))
    merged = chained.groupBy("doc_key", "template", "chain").agg(
        F.first("doc_id").alias("doc_id"), F.first("label").alias("label"), F.min("first_word").alias("first_word"),
        F.max("last_word").alias("last_word"), F.sum("votes").alias("votes"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("covered")))) / F.first("length")).alias("cover"),
    )
    return merged.filter(F.col("cover") >= min_cover).drop("chain")


def phrase_starts(tokens: Column, phrase: str) -> Column:
    parts = phrase.split()
    def at(i: Column) -> Column:
        same = F.get(tokens, i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            same = same & (F.get(tokens, i + j) == part)
        return same
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - len(parts), F.lit(0))), at)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES, **options) -> DataFrame:
    """One row per document: words, places of the phrases, their labels, all labels, and the best cover as score."""
    found = license_spans(docs, id_col, text_col, **options).groupBy("doc_key").agg(
        F.collect_set("label").alias("more"), F.max("cover").alias("cover")
    )
    counted = docs.select(_key(id_col, text_col).alias("doc_key"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    places = [phrase_starts(F.col("words"), phrase).alias(f"at_{n}") for n, phrase in enumerate(phrases)]
    starts = [F.col(f"at_{n}") for n in range(len(phrases))]
    none = F.array().cast("array<string>")
    named = F.array_distinct(F.concat(*[F.when(F.size(at) > 0, F.array(F.lit(label))).otherwise(none) for at, label in zip(starts, phrases.values(), strict=True)]))
    base = counted.select("doc_key", "doc_id", F.size("words").cast("long").alias("n_words"), *places).select(
        "doc_key", "doc_id", "n_words", F.concat(*starts).alias("starts"), named.alias("named")
    )
    joined = base.join(found, "doc_key", "left")
    return joined.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort("named"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("named", F.coalesce("more", none))), ",").alias("labels"),
        F.coalesce(F.when(F.size("starts") > 0, F.lit(1.0)), "cover", F.lit(0.0)).alias("score"),
    )
