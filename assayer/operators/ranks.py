"""Ranks and exact order statistics of groups of any number and size, computed where the rows are.

No group is collected, sorted in one task or put under a window, and nothing
that grows with the number of groups reaches the driver or is broadcast unseen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.operators import frames

# Rows of the (partition, group) count table that may be broadcast. Beyond it the join shuffles.
MAX_BROADCAST_ROWS = 200_000


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, by ``order`` within ``group``) and ``size``, the rows of the group.

    Rows are dealt by ranges of (group, order, a tie breaker) and sorted there, so
    a large group or a value that fills it covers many partitions. One count per
    partition and group then tells how many rows of the group stand in earlier
    partitions. Group columns hold no NULL; rows equal in ``order`` get their
    ranks in any order.
    """
    keys = [*map(frames.column, [*group, *order]), F.col("__tie")]
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    dealt = frames.stage(dealt.withColumn("__at", F.monotonically_increasing_id()))
    # The upper bits of the running number are the partition, the rest counts its rows.
    part = F.shiftright("__at", 33)
    names = [frames.column(g) for g in group]
    counts = dealt.groupBy(*names, part.alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    of_group = Window.partitionBy(*names)
    earlier = F.sum("__n").over(of_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = frames.stage(counts.select(
        *names, "__part", "__first", F.coalesce(earlier, F.lit(0)).alias("__before"), F.sum("__n").over(of_group).alias("size")))
    few = counts.count() <= MAX_BROADCAST_ROWS
    joined = dealt.withColumn("__part", part).join(F.broadcast(counts) if few else counts, [*group, "__part"])
    return joined.withColumn("rank", F.col("__at") - F.col("__first") + F.col("__before")).drop(
        "__at", "__part", "__first", "__before")


def _position(prob: float) -> tuple[Column, Column, Column]:
    """Ranks of the two order statistics a quantile lies between, and how far it is from the first."""
    at = (F.col("size") - 1) * F.lit(float(prob))
    low = F.floor(at)
    return low, F.least(low + 1, F.col("size") - 1), at - low


def rank_quantiles(rows: DataFrame, group: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """``(group..., quantiles array<double>)`` with linear interpolation; ``value`` is a non-null double.

    Two rows of a group at most are picked for each probability, so what is
    grouped at the end is as large as the result.
    """
    placed = ranked(rows.select(*map(frames.column, group), frames.column(value).alias("__x")), group, ["__x"])
    places = [_position(p) for p in probs]
    picked, quantiles = [], []
    wanted = F.lit(False)
    for i, (low, high, _) in enumerate(places):
        wanted = wanted | (F.col("rank") == low) | (F.col("rank") == high)
        picked += [F.max(F.when(F.col("rank") == low, F.col("__x"))).alias(f"__low{i}"),
                   F.max(F.when(F.col("rank") == high, F.col("__x"))).alias(f"__high{i}")]
        a, b = F.col(f"__low{i}"), F.col(f"__high{i}")
        quantiles.append(F.when(a == b, a).otherwise(a + (b - a) * places[i][2]))
    found = placed.where(wanted).groupBy(*map(frames.column, group)).agg(F.max("size").alias("size"), *picked)
    return found.select(*map(frames.column, group), F.array(*quantiles).alias("quantiles"))
