"""Registered queries of this subpackage and their DuckDB reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, decontamination, langid, licenses, merkle, near_dup, pseudonyms, quality_classifier, quality_rules, sharding, spelling, storage, suffix_dedup, token_rollup

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "perplexity")


def op2_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return langid.predict(docs, langid.fit(docs.filter("NOT held_out")), ("doc_id", "held_out"))


def op3_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), width=3, threshold=0.85)


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.Topology.regular(16)
    placed = sharding.place(documents(spark, sf_dir), tree, tree.grown())
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: A fixed key, so that results can be compared. Real runs pass their own secret.
SHOWN_KEY = b"shown in the open: for tests only"


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(documents(spark, sf_dir), SHOWN_KEY, count_col="n_replaced").select("doc_id", "text", "n_replaced")


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_overlaps(documents(spark, sf_dir), benchmark).withColumn("contaminated", F.lit(True))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, later copies of a text go, then the word counts are revised to count line ends too."""
    docs = documents(spark, sf_dir)
    text = F.col("text")
    counted = docs.select(
        "doc_id", "source", "lang", F.md5(F.coalesce(text, F.lit(""))).alias("digest"),
        token_rollup.count_matches(text, r"[^\x20\x09-\x0D]+").alias("words"),
        token_rollup.count_matches(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").alias("terms"),
        token_rollup.count_matches(text, r"\n").alias("lines"),
    )
    numbers = ("words", "terms", "lines")
    by_text = storage.stage(
        counted.groupBy("digest", "source", "lang").agg(
            F.count("*").alias("n_docs"), F.min("doc_id").alias("doc_id"), *[F.sum(n).alias(n) for n in numbers]
        ),
        "counts_by_text",
    )
    first = by_text.groupBy("digest").agg(
        F.min(F.struct("doc_id", "source", "lang", *[(F.col(n) / F.col("n_docs")).cast("long").alias(n) for n in numbers])).alias("first")
    ).select("first.*", F.lit(1).alias("n_docs"))

    def under(counts: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
        return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), "n_docs", F.expr(tokens).alias("n_tokens"))

    def versions(counts: DataFrame) -> DataFrame:
        return under(counts, "words-1", "words").unionByName(under(counts, "terms-1", "terms"))

    rollup = token_rollup.TokenRollup(spark, storage.new_path(spark, "rollup"))
    load = token_rollup.inserts(versions(by_text))
    rollup.apply("load", load)
    rollup.apply("copies", token_rollup.revisions(versions(by_text), versions(first)))
    rollup.compact()
    rollup.apply("line-ends", token_rollup.revisions(under(first, "words-1", "words"), under(first, "words-1", "words + lines")))
    rollup.apply("load", load)  # a repeated batch changes nothing
    return rollup.totals()


def op9_trusted_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return quality_classifier.classify(documents(spark, sf_dir), trusted)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["high"] - x["low"]).alias("n_removed")
    n_bytes = (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes")
    return done.select("doc_id", removed, F.size("spans").cast("long").alias("n_spans"), "kept").select("doc_id", n_bytes, "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_subword_softmax": op2_subword_softmax,
    "op3_bbit_minhash": op3_bbit_minhash,
    "op4_hash_tree": op4_hash_tree,
    "op5_feistel_pseudonyms": op5_feistel_pseudonyms,
    "op6_spaced_seeds": op6_spaced_seeds,
    "op7_licenses": op7_licenses,
    "op8_token_rollup": op8_token_rollup,
    "op9_trusted_perplexity": op9_trusted_perplexity,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_column_bwt": op11_column_bwt,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op8_token_rollup": r"""
        WITH firsts AS (
            SELECT source, lang, text FROM documents
            QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) = 1
        )
        SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs,
               sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)
                   + coalesce(len(regexp_extract_all(text, '\n')), 0))::BIGINT AS n_tokens
        FROM firsts GROUP BY source, lang
        UNION ALL
        SELECT source, lang, 'terms-1', count(*),
               sum(coalesce(len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')), 0))::BIGINT
        FROM firsts GROUP BY source, lang
    """,
}
