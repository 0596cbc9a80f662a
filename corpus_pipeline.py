"""From raw documents to token ids: quality rules, near-dedup, decontamination, pseudonyms, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame, which is written as Parquet
and read again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, decontamination, near_dup, pseudonyms, quality_rules, storage

#: Shown in the open so that results can be compared; a real run sets ASSAYER_PSEUDONYM_KEY.
SHOWN_KEY = "shown in the open: for tests only"
#: Near-duplicates: words in a shingle, similarity.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counting rules or leave their language's perplexity band go."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dup.deduplicate(docs, SHINGLE_WORDS, SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms of the same format."""
    return pseudonyms.pseudonymise(docs, os.environ.get("ASSAYER_PSEUDONYM_KEY", SHOWN_KEY).encode())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text as decoded from them."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii", pii),
    ("bpe", encode),
]

#: The stages count models, hash and permute; SQL can't express them. tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.stage(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
