"""Ranks of rows within groups of any size, without a window over the rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import storage

#: Rows of (partition, group) counts that are broadcast; beyond it the join shuffles.
MAX_BROADCAST_ROWS = 200_000


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with `rank` (from 0, by `order` within `group`) and `size` (rows of the group); group isn't null.

    Rows are dealt by ranges of (group, order) and sorted there, so a large group covers many partitions. A count for each
    partition and group then tells how many rows of the group come before. Rows equal in `order` get ranks in any order.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
    dealt = storage.stage(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33).alias("_part")
    counts = dealt.groupBy(group, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    within = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(within.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = storage.stage(counts.select(group, "_part", "_first", before.alias("_before"), F.sum("_n").over(within).alias("size")), f"{name}_counts")
    counts = F.broadcast(counts) if counts.count() <= MAX_BROADCAST_ROWS else counts
    joined = dealt.withColumn("_part", part).join(counts, [group, "_part"])
    return joined.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")
