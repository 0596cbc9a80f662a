"""Token totals by source, language and tokenizer version, maintained from signed deltas.

A batch is a table of signed rows (insert +, delete -, revision - old + new). It is summed by key and committed under its
id: a batch folder counts once its rename into `batches` is done, and a batch id that is there already is skipped, so a
repeated or retried batch changes nothing. Totals are the sum of all committed batches; `compact` replaces them by one
snapshot that lists the batches in it. One writer at a time.

Nulls: a null source, language or version is a key of its own; a null count is 0. Repeated rows count as often as they
come. An empty batch commits and adds nothing. Keys whose documents and tokens are both 0 are left out of the totals.
"""

from __future__ import annotations

import uuid
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import storage

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    number = lambda name: (F.coalesce(F.col(name), F.lit(0)) * sign).cast("long").alias(name)
    return counts.select(*[F.col(k).cast("string").alias(k) for k in KEYS], number("n_docs"), number("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    """Rows (source, lang, tokenizer, n_docs, n_tokens) to add: single documents or sums of them."""
    return _signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    return _signed(counts, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts that take the place of others; the key may change too."""
    return deletes(old).unionByName(inserts(new))


def count_matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern in the whole text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def apply(self, batch_id: str, deltas: DataFrame) -> bool:
        """Commit a batch; False, and no change, if this id is committed already."""
        if batch_id in self.batches():
            return False
        summed = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        self._publish(summed, f"batches/{quote(batch_id, safe='')}")
        return True

    def batches(self) -> set[str]:
        """Committed ids, those in the snapshot included."""
        loose = {unquote(p.rpartition("/")[2]) for p in storage.children(self.spark, f"{self.path}/batches")}
        return loose | self._snapshot()[1]

    def totals(self) -> DataFrame:
        parts = [self._read(p) for p in self._sources()]
        everything = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], SCHEMA)
        summed = everything.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.filter("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold the committed batches into a new snapshot. Batch folders it lists are no longer read."""
        number, done = self._snapshot()
        ids = sorted(self.batches())
        if set(ids) == done:
            return
        listed = self.totals().withColumn("batch", F.lit(None).cast("string"))
        names = self.spark.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("batch"))
        self._publish(listed.unionByName(names, allowMissingColumns=True), f"snapshots/{number + 1:012d}")

    def _snapshot(self) -> tuple[int, set[str]]:
        """Number of the last snapshot (0: none) and the batch ids in it."""
        found = storage.children(self.spark, f"{self.path}/snapshots")
        if not found:
            return 0, set()
        ids = self.spark.read.parquet(found[-1]).filter("batch IS NOT NULL").select("batch")
        return int(found[-1].rpartition("/")[2]), {r.batch for r in ids.toLocalIterator()}

    def _sources(self) -> list[str]:
        number, done = self._snapshot()
        loose = [p for p in storage.children(self.spark, f"{self.path}/batches") if unquote(p.rpartition("/")[2]) not in done]
        return loose + ([f"{self.path}/snapshots/{number:012d}"] if number else [])

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(path)

    def _publish(self, df: DataFrame, name: str) -> None:
        """Write beside the target and rename: readers see all of it or nothing."""
        work = f"{self.path}/work/{uuid.uuid4().hex}"
        df.coalesce(1).write.parquet(work)
        fs, source = storage.file_system(self.spark, work)
        _, target = storage.file_system(self.spark, f"{self.path}/{name}")
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"{name} could not be committed")
