"""Exact linear-interpolation quantiles that also hold at scale.

Spark's ``percentile`` keeps every distinct value of a group in one buffer, so it
is used only behind a check of their number. Beyond it, a sketch proposes a
bracket around each wanted rank of a column, or of each of a few groups, and
exact counts confirm it. What that cannot settle, and many large groups, are
ranked by a distributed sort (see ``ranks``), from which the order statistics
are picked. The result is exact either way.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.operators import frames, ranks

# Up to this many distinct values the built-in exact percentile is the quickest way.
SMALL_DISTINCT = 10_000
# Distinct values one exact percentile buffer may hold at most.
BUFFER_LIMIT = 1_000_000
# Accuracy of the sketch that proposes brackets: rank error 1 / accuracy.
SKETCH_ACCURACY = 10_000
# The same where every group has a sketch, and up to how many groups have one. Tasks hand on a sketch per group.
GROUP_ACCURACY = 2_000
SKETCHED_GROUPS = 1_000


def interpolate(low: float, high: float, fraction: float) -> float:
    return low if low == high else low + (high - low) * fraction


def _ranks(n: int, prob: float) -> tuple[int, int, float]:
    position = (n - 1) * prob
    low = math.floor(position)
    return low, min(low + 1, n - 1), position - low


def column_quantiles(df: DataFrame, values: Mapping[str, Column], probs: Sequence[float],
                     distincts: Mapping[str, int] | None = None) -> dict[str, list[float] | None]:
    """Quantiles of several columns of a table; None for a column without values.

    Columns with few distinct values take the exact ``percentile``. The
    others take a sketch for a bracket around each rank, then exact counts that
    prove the bracket right; what a bracket cannot settle is ranked by a sort.
    """
    if not values:
        return {}
    if distincts is None:
        got = df.agg(*[F.approx_count_distinct(v).alias(f"d{i}")
                       for i, v in enumerate(values.values())]).first()
        distincts = {c: got[i] for i, c in enumerate(values)}
    small = [c for c in values if distincts[c] <= SMALL_DISTINCT]
    large = {c: v for c, v in values.items() if c not in small}
    found = _few_passes(df, {c: values[c] for c in small}, large, probs)
    unsettled = [c for c in values if c not in found]
    if unsettled:
        pairs = [F.struct(F.lit(c).alias("item"), values[c].cast("double").alias("x")) for c in unsettled]
        long = df.select(F.inline(F.array(*pairs))).where(F.col("x").isNotNull())
        sorted_ = {r["item"]: r["quantiles"] for r in ranks.rank_quantiles(long, ["item"], "x", probs).collect()}
        found |= {c: sorted_.get(c) for c in unsettled}
    return found


def _few_passes(df: DataFrame, small: Mapping[str, Column], large: Mapping[str, Column],
                probs: Sequence[float]) -> dict[str, list[float] | None]:
    """Narrow passes: sketch the brackets of large columns, count them and take the small columns' quantiles, read the ranks.

    A large column is left out when a count disproves one of its brackets or a
    bracket holds too many distinct values.
    """
    names = list(large)
    rows = df.select(*[v.cast("double").alias(f"x{i}") for i, v in enumerate(large.values())],
                     *[v.alias(f"s{i}") for i, v in enumerate(small.values())])
    exact = [F.percentile(f"s{i}", F.array(*map(F.lit, probs))).alias(f"q{i}") for i in range(len(small))]
    found: dict[str, list[float] | None] = {}
    if not large:
        got = rows.agg(*exact).first()
        return {c: got[f"q{i}"] for i, c in enumerate(small)}
    margin = 2.0 / SKETCH_ACCURACY
    ends = [min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)]
    sketch = rows.agg(*[e for i in range(len(names)) for e in (
        F.count(f"x{i}").alias(f"n{i}"),
        F.percentile_approx(f"x{i}", ends, SKETCH_ACCURACY).alias(f"e{i}"))]).first()
    brackets = {  # (column number, prob number) -> bracket
        (i, j): (sketch[f"e{i}"][2 * j], sketch[f"e{i}"][2 * j + 1])
        for i in range(len(names)) if sketch[f"n{i}"] for j in range(len(probs))
    }
    found |= {n: None for i, n in enumerate(names) if not sketch[f"n{i}"]}
    if not brackets and not small:
        return found
    counts = list(exact)
    for (i, j), (low, high) in brackets.items():
        x = F.col(f"x{i}")
        inside = x.between(F.lit(low), F.lit(high))
        counts += [F.count_if(x < F.lit(low)).alias(f"b{i}_{j}"), F.count_if(inside).alias(f"i{i}_{j}"),
                   F.approx_count_distinct(F.when(inside, x)).alias(f"d{i}_{j}")]
    counted = rows.agg(*counts).first()
    found |= {c: counted[f"q{i}"] for i, c in enumerate(small)}
    proven: dict[tuple[int, int], list[int]] = {}  # ranks inside the bracket
    failed = set()
    for (i, j) in brackets:
        low, high, _ = _ranks(sketch[f"n{i}"], probs[j])
        below, inside = counted[f"b{i}_{j}"], counted[f"i{i}_{j}"]
        if below <= low and high < below + inside and counted[f"d{i}_{j}"] <= BUFFER_LIMIT:
            proven[i, j] = [r - below for r in (low, high)]
        else:
            failed.add(i)
    good = {k: f for k, f in proven.items() if k[0] not in failed}
    if not good:
        return found
    # Each bracket is a group of its own: its distinct values are counted, then summed up in order.
    inner = rows.select(F.inline(F.array(*[
        F.struct(F.lit(f"{i}_{j}").alias("bracket"), F.when(F.col(f"x{i}").between(*map(F.lit, brackets[i, j])), F.col(f"x{i}")).alias("y"))
        for i, j in good
    ]))).where(F.col("y").isNotNull())
    upto = F.sum("n").over(Window.partitionBy("bracket").orderBy("y"))
    steps = inner.groupBy("bracket", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    wanted = F.lit(False)
    for (i, j), places in good.items():
        for place in places:
            wanted = wanted | ((F.col("bracket") == f"{i}_{j}") & (F.col("upto") > place) & (F.col("upto") - F.col("n") <= place))
    settled: dict[str, list] = {}
    for row in steps.where(wanted).collect():  # two rows per bracket at most
        settled.setdefault(row["bracket"], []).append((row["upto"] - row["n"], row["upto"], row["y"]))
    ranks_of = {
        (i, j): [next(y for low, high, y in settled[f"{i}_{j}"] if low <= place < high) for place in places]
        for (i, j), places in good.items()
    }
    for i, name in enumerate(names):
        if (i, 0) in good:
            found[name] = [
                interpolate(*ranks_of[i, j], _ranks(sketch[f"n{i}"], p)[2]) for j, p in enumerate(probs)
            ]
    return found


def grouped_quantiles(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                      probs: Sequence[float]) -> DataFrame:
    """``(keys..., item, quantiles array<double>)`` for any number of groups of any size.

    ``values`` are numeric columns; rows where one is NULL do not count for it.
    ``keys`` hold no NULL. Groups of few distinct values take the built-in
    percentile. A few large groups take brackets, so that what is shuffled is a
    sketch per task and group and the small part of the rows in the brackets.
    Many groups take the percentile if the largest fits a buffer; otherwise all
    are ranked.
    """
    rows = df.select(*map(frames.column, keys), *[frames.column(v).cast("double").alias(v) for v in values])
    named = list(map(frames.column, keys))
    sizes = rows.groupBy(*named).agg(*[F.approx_count_distinct(frames.column(v)).alias(v) for v in values])
    *widest, groups = sizes.agg(*[F.max(frames.column(v)) for v in values], F.count(F.lit(1))).first()
    large = [v for v, n in zip(values, widest) if (n or 0) > SMALL_DISTINCT]
    if large and groups <= SKETCHED_GROUPS:
        small = [v for v in values if v not in large]
        found = _bracketed(rows, keys, large, probs)
        return found.unionByName(_percentiles(rows, keys, small, probs)) if small else found
    if max(n or 0 for n in widest) <= BUFFER_LIMIT:
        return _percentiles(rows, keys, values, probs)
    return ranks.rank_quantiles(_cells(rows, keys, values), [*keys, "item"], "__value", probs)


def _cells(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    items = [F.struct(F.lit(v).alias("item"), frames.column(v).alias("__value")) for v in values]
    return rows.select(*map(frames.column, keys), F.inline(F.array(*items))).where(F.col("__value").isNotNull())


def _percentiles(rows: DataFrame, keys: Sequence[str], values: Sequence[str], probs: Sequence[float]) -> DataFrame:
    named = list(map(frames.column, keys))
    wide = rows.groupBy(*named).agg(
        *[F.percentile(frames.column(v), F.array(*map(F.lit, probs))).alias(f"q{i}") for i, v in enumerate(values)]
    )
    items = [F.struct(F.lit(v).alias("item"), F.col(f"q{i}").alias("quantiles")) for i, v in enumerate(values)]
    return wide.select(*named, F.inline(F.array(*items))).where(F.col("quantiles").isNotNull())


def _bracketed(rows: DataFrame, keys: Sequence[str], values: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles of a few groups: a sketch proposes brackets, exact counts prove them, the ranks are read inside.

    Groups with a bracket that a count disproves are ranked by a sort. What is
    broadcast has one row per group.
    """
    named = list(map(frames.column, keys))
    pairs = [(i, j) for i in range(len(values)) for j in range(len(probs))]
    x = [F.col(f"__x{i}") for i in range(len(values))]
    margin = 2.0 / GROUP_ACCURACY
    ends = [min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)]
    cells = rows.select(*named, *[frames.column(v).alias(f"__x{i}") for i, v in enumerate(values)])
    # the ends of a short group are all its values, for there the margin is less than a rank
    whole = F.lit(10 * GROUP_ACCURACY)
    sketch = frames.stage(cells.groupBy(*named).agg(*[e for i, v in enumerate(x) for e in (
        F.count(v).alias(f"__n{i}"),
        F.when(F.count(v) <= whole, F.array(*[F.min(v), F.max(v)] * len(probs)))
        .otherwise(F.percentile_approx(v, ends, GROUP_ACCURACY)).alias(f"__e{i}"))]))
    inside = {(i, j): x[i].between(F.col(f"__e{i}")[2 * j], F.col(f"__e{i}")[2 * j + 1]) for i, j in pairs}
    at = cells.join(F.broadcast(sketch), list(keys))
    counted = at.groupBy(*named).agg(*[e for i, j in pairs for e in (
        F.count_if(x[i] < F.col(f"__e{i}")[2 * j]).alias(f"__b{i}_{j}"), F.count_if(inside[i, j]).alias(f"__i{i}_{j}"))])
    wanted = []
    for i, j in pairs:
        place = (F.col(f"__n{i}") - 1) * F.lit(float(probs[j]))
        low, below = F.floor(place), F.col(f"__b{i}_{j}")
        high = F.least(low + 1, F.col(f"__n{i}") - 1)
        wanted.append(F.struct(
            F.lit(values[i]).alias("item"), F.lit(j).alias("__prob"), F.col(f"__n{i}").alias("__n"), (low - below).alias("__low"),
            (high - below).alias("__high"), (place - low).alias("__part"),
            ((below <= low) & (high < below + F.col(f"__i{i}_{j}"))).alias("__proven")))
    places = frames.stage(counted.join(F.broadcast(sketch), list(keys)).select(*named, F.inline(F.array(*wanted))).where("__n > 0"))
    group = [*map(frames.column, [*keys, "item"])]
    inner = at.select(*named, F.inline(F.array(*[
        F.struct(F.lit(values[i]).alias("item"), F.lit(j).alias("__prob"), F.when(inside[i, j], x[i]).alias("__y")) for i, j in pairs
    ]))).where(F.col("__y").isNotNull())
    upto = F.sum("__c").over(Window.partitionBy(*group, "__prob").orderBy("__y"))
    steps = inner.groupBy(*group, "__prob", "__y").agg(F.count(F.lit(1)).alias("__c")).withColumn("__upto", upto)
    on = [*keys, "item", "__prob"]

    def value_at(place: str):
        return F.max(F.when((F.col("__upto") > F.col(place)) & (F.col("__upto") - F.col("__c") <= F.col(place)), F.col("__y")))

    picked = steps.join(F.broadcast(places.where("__proven")), on).groupBy(*group, "__prob", "__part").agg(
        value_at("__low").alias("__a"), value_at("__high").alias("__b"))
    a, b = F.col("__a"), F.col("__b")
    read = picked.withColumn("__q", F.when((a == b) | (F.col("__part") == 0), a).otherwise(a + (b - a) * F.col("__part")))
    unproven = places.groupBy(*group).agg(F.bool_and("__proven").alias("__good")).where("NOT __good").drop("__good")
    kept = read if unproven.isEmpty() else read.join(F.broadcast(unproven), [*keys, "item"], "left_anti")
    settled = kept.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__prob", "__q"))), lambda s: s["__q"]).alias("quantiles"))
    if unproven.isEmpty():
        return settled
    rest = _cells(rows, keys, values).join(F.broadcast(unproven), [*keys, "item"], "left_semi")
    return settled.unionByName(ranks.rank_quantiles(rest, [*keys, "item"], "__value", probs))
