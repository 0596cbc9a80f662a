"""Exploration: overview, distributions, correlations, category effects, associations, time trends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions import dates, stats
from assayer.operators import anomalies, frames, quantiles
from assayer.operators.anomalies import Table
from assayer.operators.profile import Profile, top_values

# Fixed limits and thresholds of the exploration report.
MIN_OBSERVATIONS, MIN_GROUP = 3, 2
MIN_GROUPS, MAX_GROUPS = 2, 30
HIGH_CARDINALITY, HIGH_CARDINALITY_RATIO = 100, 0.50
CORRELATION_CUT, EFFECT_CUT, ASSOCIATION_CUT, TREND_CUT = 0.40, 0.10, 0.20, 0.30
HIGH_MISSING, CO_MISSING = 30.0, 0.50
DIGITS = 6
# Share of a sum of squares below which a spread is rounding error of a constant.
NO_SPREAD = 1e-13

PAIR_FIELDS = "column_1 string, column_2 string, correlation double, observations long"
EFFECT_FIELDS = ("categorical_column string, numerical_column string, effect_size double, "
                 "highest_mean_group string, lowest_mean_group string, mean_difference double")
ASSOCIATION_FIELDS = "column_1 string, column_2 string, cramers_v double, strength string"
TREND_FIELDS = ("datetime_column string, numerical_column string, observations long, trend_correlation double, "
                "trend_strength string, direction string, first_value double, last_value double, "
                "absolute_change double, percentage_change double")


def r6(col: Column | str) -> Column:
    return F.round(col, DIGITS)


def top(ranked: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of a final ranking; all of them without a limit."""
    return ranked if limit is None else ranked.limit(limit)


def _empty(table: Table, fields: str) -> DataFrame:
    return frames.local_rows(table.df.sparkSession, [], fields)


# -- overview and missingness --------------------------------------------------

def missing_by_column(table: Table | DataFrame) -> DataFrame:
    """NULL cells per column (text markers are not missing here)."""
    table = Table.of(table)
    return frames.aggregate_columns(table.df, {
        c: {"rows": F.count(F.lit(1)), "missing_count": stats.count_if(table.ref(c).isNull())}
        for c in table.columns
    }).withColumn("missing_percentage", r6(stats.percent(F.col("missing_count"), F.col("rows"))))


def high_missing_columns(by_column: DataFrame) -> DataFrame:
    return by_column.where(stats.percent(F.col("missing_count"), F.col("rows")) >= HIGH_MISSING).select(
        "column", "missing_percentage").orderBy(F.desc("missing_percentage"), "column")


def overview(table: Table | DataFrame, types: Mapping | None = None) -> DataFrame:
    """One row: size, missing cells and duplicate rows."""
    table = Table.of(table, types)
    duplicates = table.duplicate_summary.first()
    rows, surplus = duplicates["rows"], duplicates["duplicate_rows"]
    return missing_by_column(table).agg(F.sum("missing_count").alias("total_missing")).select(
        F.lit(rows).cast("long").alias("rows"),
        F.lit(len(table.columns)).cast("long").alias("columns"),
        F.lit(rows * len(table.columns)).cast("long").alias("total_cells"),
        "total_missing",
        r6(stats.percent(F.col("total_missing"), F.lit(rows * len(table.columns)))).alias("missing_percentage"),
        F.lit(surplus).cast("long").alias("duplicate_rows"),
        r6(stats.percent(F.lit(surplus), F.lit(rows))).alias("duplicate_percentage"),
    )


def type_counts(table: Table) -> DataFrame:
    kinds = [table.types.get(c, "unknown").lower() for c in table.columns]
    return frames.report(table.df.sparkSession,
                         [{"detected_type": k, "columns": kinds.count(k)} for k in sorted(set(kinds))],
                         "detected_type string, columns long")


def co_missing_pairs(table: Table | DataFrame) -> DataFrame:
    """Column pairs missing together: Jaccard index of their NULL rows, at least 0.5."""
    table = Table.of(table)
    counts = {r["column"]: r["missing_count"] for r in missing_by_column(table).collect()}
    names = [c for c in table.columns if counts[c]]
    if len(names) < 2:
        return _empty(table, "column_1 string, column_2 string, both_missing long, jaccard_similarity double")
    missing = table.df.select(*[F.when(table.ref(c).isNull(), F.lit(1.0)).alias(f"x{i}") for i, c in enumerate(names)])
    both = missing.mapInArrow(cross_products([0.0] * len(names)), CROSS_FIELDS).groupBy("i", "j").agg(F.sum("n").alias("n"))
    labels, totals = F.array(*map(F.lit, names)), F.array(*[F.lit(float(counts[c])) for c in names])
    share = stats.ratio(F.col("n"), F.get(totals, F.col("i")) + F.get(totals, F.col("j")) - F.col("n"))
    return (
        both.where((F.col("n") > 0) & (share >= CO_MISSING))
        .select(F.get(labels, F.col("i")).alias("column_1"), F.get(labels, F.col("j")).alias("column_2"),
                F.col("n").cast("long").alias("both_missing"), r6(share).alias("jaccard_similarity"))
        .orderBy(F.desc("jaccard_similarity"), "column_1", "column_2")
    )


# -- numeric and categorical profiles ---------------------------------------------

def finite_quartiles(table: Table) -> dict[str, list[float]]:
    names = table.kinds("Numerical")
    found = quantiles.column_quantiles(
        table.df, {c: table.finite(c) for c in names}, [0.25, 0.5, 0.75], table.approx)
    return {c: q for c, q in found.items() if q}


def numeric_profile(table: Table | DataFrame, types: Mapping | None = None) -> DataFrame:
    """Full numeric profile per Numerical column, with IQR outliers; infinities are missing."""
    table = Table.of(table, types)
    names = table.kinds("Numerical")
    if not names:
        return _empty(table, "column string, count long")
    quartiles = finite_quartiles(table)
    # Exact distinct counts in their own job: mixing them into the wide
    # aggregate would drag every buffer through the distinct shuffle.
    uniques = frames.exact_distincts(table.df, {c: table.finite(c) for c in names})
    metrics, known = {}, {}
    for c in names:
        x = table.finite(c)
        q1, median, q3 = quartiles.get(c, (None, None, None))
        low = high = None
        if q1 is not None:
            low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        known[c] = {
            k: F.lit(v).cast("double") for k, v in (
                ("median", median), ("q1", q1), ("q3", q3), ("lower_bound", low), ("upper_bound", high))
        } | {"unique_values": F.lit(uniques[c]).cast("long")}
        metrics[c] = {
            "rows": F.count(F.lit(1)), "count": F.count(x), "mean": F.avg(x), "min": F.min(x), "max": F.max(x),
            "std": F.when(F.count(x) > 1, F.stddev_samp(x)),
            "variance": F.when(F.count(x) > 1, F.var_samp(x)),
            "skewness": stats.adjusted_skew(x), "kurtosis": stats.adjusted_kurtosis(x),
            "zero_count": stats.count_if(x == 0), "negative_count": stats.count_if(x < 0),
            "positive_count": stats.count_if(x > 0),
            "outlier_count": stats.count_if((x < F.lit(low)) | (x > F.lit(high))) if q1 is not None
            else F.lit(0).cast("long"),
        }
    p = frames.aggregate_columns(table.df, metrics, constants=known)
    c = F.col
    enough = c("count") >= 4
    share = lambda part: r6(F.try_divide(c(part) * 100.0, c("count").cast("double")))
    return p.select(
        "column", "count", (c("rows") - c("count")).alias("missing_count"),
        r6(stats.percent(c("rows") - c("count"), c("rows"))).alias("missing_percentage"),
        "unique_values", *[r6(m).alias(m) for m in ("mean", "median", "min", "max")],
        r6(c("max") - c("min")).alias("range"), r6("std").alias("std"), r6("variance").alias("variance"),
        r6("q1").alias("q1"), r6("q3").alias("q3"), r6(c("q3") - c("q1")).alias("iqr"),
        r6("skewness").alias("skewness"), r6("kurtosis").alias("kurtosis"),
        stats.distribution_shape(c("skewness")).alias("distribution_shape"),
        r6(F.abs(F.try_divide(c("std"), c("mean")))).alias("coefficient_of_variation"),
        "zero_count", share("zero_count").alias("zero_percentage"),
        "negative_count", share("negative_count").alias("negative_percentage"),
        "positive_count", share("positive_count").alias("positive_percentage"),
        r6(F.when(enough, c("lower_bound"))).alias("lower_bound"),
        r6(F.when(enough, c("upper_bound"))).alias("upper_bound"),
        F.when(enough, c("outlier_count")).otherwise(0).cast("long").alias("outlier_count"),
        r6(F.when(enough, stats.percent(c("outlier_count"), c("count"))).otherwise(0.0)).alias("outlier_percentage"),
    )


def raw_counts(table: Table, names: Sequence[str]) -> DataFrame:
    return frames.value_counts(table.df, {c: table.ref(c) for c in names})


def categorical_profile(table: Table | DataFrame, types: Mapping | None = None) -> DataFrame:
    """Counts, cardinality, mode, dominance and entropy per Categorical or Boolean column.

    Entropy comes from sums over the frequency table: log2(N) - sum(n*log2(n))/N.
    """
    table = Table.of(table, types)
    names = table.kinds("Categorical", "Boolean")
    if not names:
        return _empty(table, "column string, count long")
    n, total, unique = F.col("n"), F.col("count"), F.col("unique_values")
    shapes = raw_counts(table, names).groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique_values"),
        F.min_by("value", F.struct(-n, F.col("value"))).alias("most_common"),
        F.max("n").alias("most_common_count"), F.sum(n * F.log2(n)).alias("nlogn"),
    )
    rows = frames.aggregate_columns(table.df, {c: {"rows": F.count(F.lit(1))} for c in names})
    entropy = F.when(total > 0, F.greatest(F.lit(0.0), F.log2(total) - F.col("nlogn") / total))
    return rows.join(F.broadcast(shapes), "column", "left").select(  # one row per column
        "column", F.coalesce("count", F.lit(0)).alias("count"),
        (F.col("rows") - F.coalesce("count", F.lit(0))).alias("missing_count"),
        r6(stats.percent(F.col("rows") - F.coalesce("count", F.lit(0)), F.col("rows"))).alias("missing_percentage"),
        F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
        r6(stats.ratio(unique, total)).alias("cardinality_ratio"),
        F.coalesce((unique >= HIGH_CARDINALITY) | (stats.ratio(unique, total) >= HIGH_CARDINALITY_RATIO),
                   F.lit(False)).alias("high_cardinality"),
        "most_common", F.coalesce("most_common_count", F.lit(0)).alias("most_common_count"),
        r6(stats.percent(F.col("most_common_count"), total)).alias("dominance_percentage"),
        r6(entropy).alias("entropy"),
        r6(F.when(F.coalesce(unique, F.lit(0)) <= 1, 0.0).otherwise(F.try_divide(entropy, F.log2(unique)))).alias("normalized_entropy"),
    )


# -- correlations --------------------------------------------------------------------

def usable_numeric(table: Table, minimum: int = MIN_OBSERVATIONS) -> list[str]:
    """Numerical columns with enough finite values and more than one of them."""
    ranges = table.finite_ranges
    return [c for c, (n, low, high) in ranges.items() if n >= minimum and low != high]


def correlation_pairs(table: Table | DataFrame, types: Mapping | None = None,
                      columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of usable numeric columns, pairwise complete.

    One scan, however many columns: each task adds up the cross products of its
    rows as matrices and hands on one row per pair. Values are taken from the
    column means first, so large ones don't cost digits.
    """
    table = Table.of(table, types)
    names = list(columns) if columns is not None else usable_numeric(table)
    if len(names) < 2:
        return _empty(table, PAIR_FIELDS)
    numbers = table.df.select(*[table.finite(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    means = numbers.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(names))]).first()
    sums = numbers.mapInArrow(cross_products([m or 0.0 for m in means]), CROSS_FIELDS).groupBy("i", "j").agg(
        *[F.sum(f).alias(f) for f in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    c = F.col

    def spread_of(v: str) -> Column:
        square = c("n") * c(f"s{v}{v}")
        rest = square - c(f"s{v}") * c(f"s{v}")
        return F.when(rest > NO_SPREAD * square, F.sqrt(rest))

    spread = spread_of("x") * spread_of("y")
    r = F.try_divide(c("n") * c("sxy") - c("sx") * c("sy"), spread)
    labels = F.array(*map(F.lit, names))
    return sums.where((c("n") >= MIN_OBSERVATIONS) & r.isNotNull()).select(
        F.get(labels, c("i")).alias("column_1"), F.get(labels, c("j")).alias("column_2"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("correlation"), c("n").cast("long").alias("observations"))


CROSS_FIELDS = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"


def cross_products(means: Sequence[float]):
    """For mapInArrow: sums over the rows of a task for each pair i < j, of rows where both are present."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        k = len(means)
        total = np.zeros((6, k, k))
        for batch in batches:
            x = np.column_stack([column.to_numpy(zero_copy_only=False) for column in batch.columns]).astype(float) - np.array(means)
            here = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            square = x * x
            total += [here.T @ here, x.T @ here, here.T @ x, square.T @ here, here.T @ square, x.T @ x]
        i, j = np.triu_indices(k, 1)
        arrays = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(t[i, j]) for t in total)]
        yield pa.RecordBatch.from_arrays(arrays, ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    return run


def ranked_correlations(pairs: DataFrame, minimum: float = 0.0, limit: int | None = None) -> DataFrame:
    """Pairs with strength and direction, strongest first."""
    r = r6("correlation")
    ranked = pairs.select(
        "column_1", "column_2", r.alias("correlation"), F.abs(r).alias("absolute_correlation"),
        stats.correlation_strength(r).alias("strength"), stats.correlation_direction(r).alias("direction"),
        "observations",
    ).where(F.col("absolute_correlation") >= minimum)
    return top(ranked.orderBy(F.desc("absolute_correlation"), "column_1", "column_2"), limit)


def strongest_correlations(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    return ranked_correlations(pairs, CORRELATION_CUT, limit)


def correlation_matrix(pairs: DataFrame, columns: Sequence[str], digits: int = DIGITS) -> DataFrame:
    """Both triangles and the diagonal as ``(x, y, correlation)`` rows."""
    one = F.round(F.col("correlation"), digits).alias("correlation")
    diagonal = frames.local_rows(pairs.sparkSession, [(c, c, 1.0) for c in columns], "x string, y string, correlation double")
    return frames.union_all([
        diagonal,
        pairs.select(F.col("column_1").alias("x"), F.col("column_2").alias("y"), one),
        pairs.select(F.col("column_2").alias("x"), F.col("column_1").alias("y"), one),
    ])


# -- category effects and associations --------------------------------------------------

def usable_categories(table: Table, lowest: int = MIN_GROUPS, highest: int = MAX_GROUPS) -> list[str]:
    """Categorical and Boolean columns whose distinct count lies in the range.

    Columns that are far above it by the approximate count are not counted exactly.
    """
    approx = table.approx_counts(table.kinds("Categorical", "Boolean"))
    names = [c for c in approx if approx[c] <= highest * 2]
    exact = table.distinct_counts(names)
    return [c for c in names if lowest <= exact[c] <= highest]


def skipped_categories(table: Table, lowest: int = MIN_GROUPS, highest: int = MAX_GROUPS) -> DataFrame:
    """``(column, reason)`` of the category columns that effects and associations leave out."""
    used = set(usable_categories(table, lowest, highest))
    names = [c for c in table.kinds("Categorical", "Boolean") if c not in used]
    rows = [(c, f"fewer than {lowest} or more than {highest} groups") for c in names]
    return frames.local_rows(table.df.sparkSession, rows, "column string, reason string")


GROUP_KEYS = ("categorical_column", "category")


def _by_category(table: Table, categories: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Rows once per category column, with the numeric columns side by side as x0, x1, ..."""
    cells = [F.struct(F.lit(c).alias("categorical_column"), table.ref(c).cast("string").alias("category"))
             for c in categories]
    return table.df.select(
        *[table.finite(c).alias(f"x{i}") for i, c in enumerate(numbers)], F.inline(F.array(*cells))
    ).where(F.col("category").isNotNull())


def category_numeric_moments(table: Table | DataFrame, types: Mapping | None = None) -> DataFrame:
    """Count, mean, deviation and range of every numeric column within every category.

    Groups of two rows and more, of columns with 2 to 30 categories. Map-side
    combined, so a category of any size is one row per task.
    """
    table = Table.of(table, types)
    categories, numbers = usable_categories(table), table.kinds("Numerical")
    if not categories or not numbers:
        return _empty(table, "categorical_column string, category string, numerical_column string, item string, "
                             "count long, mean double, std double, min double, max double")
    values = [f"x{i}" for i in range(len(numbers))]
    wide = _by_category(table, categories, numbers).groupBy(*GROUP_KEYS).agg(*[
        F.struct(
            F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max"),
        ).alias(v) for v in values
    ])
    items = [F.struct(F.lit(c).alias("numerical_column"), F.lit(v).alias("item"), F.col(v).alias("s"))
             for c, v in zip(numbers, values)]
    rows = wide.select(*GROUP_KEYS, F.inline(F.array(*items)))
    return rows.select(*GROUP_KEYS, "numerical_column", "item", "s.*").where(F.col("count") >= MIN_GROUP)


def category_numeric_groups(table: Table | DataFrame, types: Mapping | None = None) -> DataFrame:
    """The same with the exact median of every group."""
    table = Table.of(table, types)
    moments = category_numeric_moments(table)
    categories, numbers = usable_categories(table), table.kinds("Numerical")
    if not categories or not numbers:
        return moments.withColumn("median", F.lit(None).cast("double")).drop("item")
    medians = quantiles.grouped_quantiles(
        _by_category(table, categories, numbers), GROUP_KEYS, [f"x{i}" for i in range(len(numbers))], [0.5])
    return moments.join(medians, [*GROUP_KEYS, "item"]).select(
        *GROUP_KEYS, "numerical_column", "count", "mean", F.col("quantiles")[0].alias("median"), "std", "min", "max"
    )


def category_numeric_effects(groups: DataFrame, limit: int | None = None) -> DataFrame:
    """Eta squared per (category, numeric) pair from its group statistics.

    The total sum of squares is between-group plus within-group, so the table
    is not read again. At most 30 groups per pair.
    """
    c = F.col
    pair = Window.partitionBy("categorical_column", "numerical_column")
    grand = F.sum(c("count") * c("mean")).over(pair) / F.sum("count").over(pair)
    parts = groups.withColumn("between", c("count") * F.pow(c("mean") - grand, F.lit(2.0))).withColumn(
        "within", (c("count") - 1) * F.pow(F.coalesce("std", F.lit(0.0)), F.lit(2.0)))
    between, within = F.sum("between"), F.sum("within")
    return (
        parts.groupBy("categorical_column", "numerical_column")
        .agg(
            F.count(F.lit(1)).alias("groups"), F.sum("count").alias("n"),
            F.coalesce(F.try_divide(between, between + within), F.lit(0.0)).alias("effect"),
            F.min_by("category", F.struct(-c("mean"), c("category"))).alias("highest_mean_group"),
            F.min_by("category", F.struct(c("mean"), c("category"))).alias("lowest_mean_group"),
            (F.max("mean") - F.min("mean")).alias("spread"),
        )
        .where((c("groups") >= 2) & (c("n") >= MIN_OBSERVATIONS))
        .select("categorical_column", "numerical_column", r6("effect").alias("effect_size"),
                "highest_mean_group", "lowest_mean_group", r6("spread").alias("mean_difference"))
        .orderBy(F.desc("effect_size"), "categorical_column", "numerical_column")
        .transform(top, limit)
    )


# Values a column may have for its pairs to be counted by a dictionary.
DICTIONARY_VALUES = 100
CELL_FIELDS = "i int, j int, a int, b int, n long"


def crosstabs(table: Table | DataFrame, types: Mapping | None = None,
              columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_1, column_2, value_1, value_2, n)`` for every pair of category columns.

    One scan, however many pairs: values become numbers by a small dictionary, and
    each task counts the pairs of numbers of its Arrow batches and hands on one row
    per cell. Without ``columns``, those with 2 to 30 values are taken; given ones
    with too many values for a dictionary go through rows, one per pair and row.
    """
    table = Table.of(table, types)
    names = list(columns) if columns is not None else usable_categories(table)
    if len(names) < 2:
        return _empty(table, "column_1 string, column_2 string, value_1 string, value_2 string, n long")
    if any(table.approx[c] > DICTIONARY_VALUES for c in names):
        return _crosstabs_by_row(table, names)
    values = {f"v{i}": table.ref(c).cast("string") for i, c in enumerate(names)}
    seen = frames.value_counts(table.df, values).select("column", "value").collect()  # at most a dictionary per column
    listed = [sorted(r["value"] for r in seen if r["column"] == v) for v in values]
    cells = table.df.select(*[v.alias(name) for name, v in values.items()]).mapInArrow(count_pairs(listed), CELL_FIELDS)
    words = F.array(*[F.array(*map(F.lit, words)).cast("array<string>") for words in listed])
    labels = F.array(*map(F.lit, names))
    return cells.groupBy("i", "j", "a", "b").agg(F.sum("n").alias("n")).select(
        F.get(labels, F.col("i")).alias("column_1"), F.get(labels, F.col("j")).alias("column_2"),
        F.get(F.get(words, F.col("i")), F.col("a")).alias("value_1"), F.get(F.get(words, F.col("j")), F.col("b")).alias("value_2"), "n")


def count_pairs(values: Sequence[Sequence[str]]):
    """For mapInArrow: how often two values stand in one row, over the rows of a task, for each pair of columns i < j."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        k, sizes = len(values), [len(v) + 1 for v in values]  # the last number is a missing value
        dictionaries = [pa.array(v, pa.string()) for v in values]
        total = {(i, j): np.zeros(sizes[i] * sizes[j], np.int64) for i in range(k) for j in range(i + 1, k)}
        for batch in batches:
            codes = [
                pc.fill_null(pc.index_in(column, dictionaries[i]), sizes[i] - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                for i, column in enumerate(batch.columns)
            ]
            for (i, j), counts in total.items():
                counts += np.bincount(codes[i] * sizes[j] + codes[j], minlength=len(counts))
        for (i, j), counts in total.items():
            grid = counts.reshape(sizes[i], sizes[j])[:-1, :-1]
            a, b = np.nonzero(grid)
            same = np.full(len(a), 0, np.int32)
            arrays = [pa.array(same + np.int32(i)), pa.array(same + np.int32(j)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(grid[a, b])]
            yield pa.RecordBatch.from_arrays(arrays, ["i", "j", "a", "b", "n"])

    return run


def _crosstabs_by_row(table: Table, names: Sequence[str]) -> DataFrame:
    pairs = [
        F.struct(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"),
                 table.ref(a).cast("string").alias("value_1"), table.ref(b).cast("string").alias("value_2"))
        for a, b in combinations(names, 2)
    ]
    return (
        table.df.select(F.inline(F.array(*pairs)))
        .where(F.col("value_1").isNotNull() & F.col("value_2").isNotNull())
        .groupBy("column_1", "column_2", "value_1", "value_2")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cramers_v(cells: DataFrame, limit: int | None = None) -> DataFrame:
    """Cramér's V per pair from its contingency cells; at most 30 x 30 cells per pair.

    chi2 / n = sum(o^2 / (row * column)) - 1, which also covers empty cells.
    """
    by_pair = ["column_1", "column_2"]
    marginals = cells.withColumns({
        "row": F.sum("n").over(Window.partitionBy(*by_pair, "value_1")),
        "col": F.sum("n").over(Window.partitionBy(*by_pair, "value_2")),
    })
    n = F.col("n").cast("double")
    degrees = F.least(F.count_distinct("value_1"), F.count_distinct("value_2")) - 1
    phi = F.greatest(F.lit(0.0), F.sum(n * n / (F.col("row").cast("double") * F.col("col"))) - 1)
    v = F.col("cramers_v")
    return (
        marginals.groupBy(*by_pair)
        .agg(phi.alias("phi"), degrees.alias("degrees"))
        .where(F.col("degrees") > 0)
        .select(*by_pair, r6(F.sqrt(F.col("phi") / F.col("degrees"))).alias("cramers_v"))
        .withColumn("strength", F.when(v >= 0.50, "strong").when(v >= 0.30, "moderate").otherwise("weak"))
        .orderBy(F.desc("cramers_v"), *by_pair)
        .transform(top, limit)
    )


# -- time -----------------------------------------------------------------------------

def datetime_profile(table: Table | DataFrame, types: Mapping | None = None) -> DataFrame:
    """Valid, missing and unique dates, and the range in whole elapsed days."""
    table = Table.of(table, types)
    names = table.kinds("Datetime")
    if not names:
        return _empty(table, "column string, valid_dates long, missing_dates long, missing_percentage double, "
                             "unique_dates long, earliest string, latest string, range_days long")
    uniques = frames.exact_distincts(table.df, {c: table.date(c) for c in names})
    got = frames.aggregate_columns(table.df, {
        c: {"rows": F.count(F.lit(1)), "valid_dates": F.count(table.date(c)),
            "lo": F.min(table.date(c)), "hi": F.max(table.date(c))}
        for c in names
    }, constants={c: {"unique_dates": F.lit(uniques[c]).cast("long")} for c in names}).where(F.col("valid_dates") > 0)
    return got.select(
        "column", "valid_dates", (F.col("rows") - F.col("valid_dates")).alias("missing_dates"),
        r6(stats.percent(F.col("rows") - F.col("valid_dates"), F.col("rows"))).alias("missing_percentage"),
        "unique_dates", dates.iso(F.col("lo")).alias("earliest"), dates.iso(F.col("hi")).alias("latest"),
        F.timestamp_diff("DAY", F.col("lo"), F.col("hi")).alias("range_days"),
    )


def time_means(table: Table, date_column: str, numbers: Sequence[str]) -> DataFrame:
    """Mean of each numeric column per timestamp (map-side combined)."""
    return (
        table.df.select(table.date(date_column).alias("ts"), *[table.finite(c).alias(f"x{i}") for i, c in enumerate(numbers)])
        .where(F.col("ts").isNotNull())
        .groupBy("ts").agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(numbers))])
    )


def time_trends(table: Table | DataFrame, types: Mapping | None = None, limit: int | None = None) -> DataFrame:
    """Trend of the per-timestamp mean of every numeric column over every datetime column."""
    table = Table.of(table, types)
    numbers = table.kinds("Numerical")
    parts = []
    for d in table.kinds("Datetime") if numbers else []:
        means = time_means(table, d, numbers).withColumn("t", dates.epoch_seconds(F.col("ts")))
        metrics = {}
        for i, c in enumerate(numbers):
            x = F.col(f"x{i}")
            at = F.when(x.isNotNull(), F.col("ts"))
            metrics[c] = {
                "observations": F.count(x), "r": stats.pearson(F.col("t"), x),
                "first_value": F.min_by(x, at), "last_value": F.max_by(x, at),
            }
        parts.append(frames.aggregate_columns(means, metrics, key="numerical_column")
                     .withColumn("datetime_column", F.lit(d)))
    if not parts:
        return _empty(table, TREND_FIELDS)
    c = F.col
    change = c("last_value") - c("first_value")
    return (
        frames.union_all(parts)
        .where(c("observations") >= MIN_OBSERVATIONS)
        .withColumn("r", r6("r"))
        .select(
            "datetime_column", "numerical_column", "observations", c("r").alias("trend_correlation"),
            stats.correlation_strength(c("r")).alias("trend_strength"),
            F.when(c("r").isNull(), "unknown").when(c("r") >= TREND_CUT, "increasing")
            .when(c("r") <= -TREND_CUT, "decreasing").otherwise("stable_or_irregular").alias("direction"),
            r6("first_value").alias("first_value"), r6("last_value").alias("last_value"),
            r6(change).alias("absolute_change"),
            r6(F.try_divide(change * 100, F.abs(c("first_value")))).alias("percentage_change"),
        )
        .orderBy(F.desc(F.coalesce(F.abs("trend_correlation"), F.lit(0.0))), "datetime_column", "numerical_column")
        .transform(top, limit)
    )


# -- rankings over the sections -----------------------------------------------------------

def important_relationships(correlations: DataFrame, effects: DataFrame, associations: DataFrame,
                            trends: DataFrame, limit: int | None = None) -> DataFrame:
    """The strongest relationships of all four kinds, by score."""
    def part(df: DataFrame, kind: str, a: str, b: str, score: Column, cut: float) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), F.col(a).alias("column_1"), F.col(b).alias("column_2"),
                         score.alias("score")).where(F.col("score") >= cut)

    return frames.union_all([
        part(correlations, "numeric_correlation", "column_1", "column_2",
             F.abs(r6("correlation")), CORRELATION_CUT),
        part(effects, "category_numeric", "categorical_column", "numerical_column", F.col("effect_size"), EFFECT_CUT),
        part(associations, "categorical_association", "column_1", "column_2", F.col("cramers_v"), ASSOCIATION_CUT),
        part(trends, "time_trend", "datetime_column", "numerical_column",
             F.coalesce(F.abs("trend_correlation"), F.lit(0.0)), TREND_CUT),
    ]).orderBy(F.desc("score"), "type", "column_1", "column_2").transform(top, limit)


def eda_flags(overview_row: DataFrame, missing: DataFrame, numeric: DataFrame, categorical: DataFrame) -> DataFrame:
    """Caveats: duplicates, missingness, outliers, negatives, cardinality, dominance."""
    c = F.col
    say = lambda form, *cols: F.format_string(form, *map(F.col, cols))
    nothing = F.lit(None).cast("string")
    parts = [
        anomalies.explode_issues(overview_row, [
            (c("duplicate_percentage") >= 5, "duplicate_rows", "medium",
             say("%.2f%% of rows are duplicates", "duplicate_percentage")),
        ], nothing),
        anomalies.explode_issues(missing, [
            (c("missing_percentage") >= HIGH_MISSING, "high_missingness",
             F.when(c("missing_percentage") >= 50, "high").otherwise("medium"),
             say("%s: %.2f%% missing", "column", "missing_percentage")),
        ], c("column")),
    ]
    if "outlier_percentage" in numeric.columns:
        parts.append(anomalies.explode_issues(numeric, [
            (c("outlier_percentage") >= 5, "outliers",
             F.when(c("outlier_percentage") >= 15, "high").otherwise("medium"),
             say("%s: %.2f%% outliers", "column", "outlier_percentage")),
            (c("negative_percentage") > 0, "negative_values", "info",
             say("%s: %.2f%% negative", "column", "negative_percentage")),
        ], c("column")))
    if "high_cardinality" in categorical.columns:
        parts.append(anomalies.explode_issues(categorical, [
            (c("high_cardinality"), "high_cardinality", "info", say("%s: %d categories", "column", "unique_values")),
            (c("dominance_percentage") >= 90, "dominant_category", "info",
             say("%s: %.2f%% are one category", "column", "dominance_percentage")),
        ], c("column")))
    return frames.union_all(parts)


def chart_recommendations(table: Table, correlations: DataFrame, effects: DataFrame, trends: DataFrame,
                          columns: int | None = 8, relationships: int | None = 5) -> DataFrame:
    """Chart candidates: so many histograms and bars in column order, and so many scatters, boxes and lines by strength.

    The limits are those of the final list; None shows all.
    """
    spark = table.df.sparkSession
    fields = "place int, chart string, x string, y string, intent string"
    simple = [(i, "histogram", n, None, "distribution") for i, n in enumerate(table.kinds("Numerical")[:columns])]
    simple += [(10_000 + i, "bar", n, "count", "category_frequency")
               for i, n in enumerate(table.kinds("Categorical", "Boolean")[:columns])]

    def ranked(df: DataFrame, base: int, chart: str, x: str, y: str, score: Column, cut: float, intent: str):
        order = Window.orderBy(F.desc(score), x, y)  # report-sized: one row per relationship
        wanted = score >= cut if relationships is None else (score >= cut) & (F.col("nth") <= relationships)
        return df.withColumn("nth", F.row_number().over(order)).withColumn("place", F.col("nth") + base).where(wanted).select("place", F.lit(chart).alias("chart"), F.col(x).alias("x"), F.col(y).alias("y"),
                 F.lit(intent).alias("intent"))

    return frames.union_all([
        frames.local_rows(spark, simple, fields),
        ranked(correlations, 10_000_000, "scatter", "column_1", "column_2", F.abs(r6("correlation")),
               CORRELATION_CUT, "relationship"),
        ranked(effects, 100_000_000, "box", "categorical_column", "numerical_column", F.col("effect_size"),
               EFFECT_CUT, "group_comparison"),
        ranked(trends, 1_000_000_000, "line", "datetime_column", "numerical_column",
               F.coalesce(F.abs("trend_correlation"), F.lit(0.0)), TREND_CUT, "time_trend"),
    ]).orderBy("place").select("chart", "x", "y", "intent")


class EdaReport:
    """All exploration sections; report-sized ones are settled on first use."""

    def __init__(self, table: Table):
        self.table = table

    @cached_property
    def overview(self) -> DataFrame:
        return frames.settle(overview(self.table))

    @cached_property
    def type_counts(self) -> DataFrame:
        return type_counts(self.table)

    @cached_property
    def missing(self) -> DataFrame:
        return frames.settle(missing_by_column(self.table))

    @property
    def high_missing(self) -> DataFrame:
        return high_missing_columns(self.missing)

    @cached_property
    def co_missing(self) -> DataFrame:
        return frames.settle(co_missing_pairs(self.table))

    @cached_property
    def numeric(self) -> DataFrame:
        return frames.settle(numeric_profile(self.table))

    @cached_property
    def categorical(self) -> DataFrame:
        return frames.settle(categorical_profile(self.table))

    @cached_property
    def top_categories(self) -> DataFrame:
        names = self.table.kinds("Categorical", "Boolean")
        return frames.settle(top_values(self.table.df, names)) if names else _empty(
            self.table, "column string, value string, n long, place int")

    @cached_property
    def correlation_pairs(self) -> DataFrame:
        return frames.settle(correlation_pairs(self.table))

    @property
    def correlations(self) -> DataFrame:
        return ranked_correlations(self.correlation_pairs)

    @cached_property
    def flat_correlations(self) -> DataFrame:
        return self.correlations.select(
            F.concat_ws(" vs ", "column_1", "column_2").alias("pair"), "correlation")

    @cached_property
    def distributions(self) -> DataFrame:
        return self.numeric.select("column", "skewness", F.col("distribution_shape").alias("shape"))

    @cached_property
    def category_groups(self) -> DataFrame:
        return frames.settle(category_numeric_groups(self.table))

    @cached_property
    def effects(self) -> DataFrame:
        return frames.settle(category_numeric_effects(category_numeric_moments(self.table)))

    @cached_property
    def associations(self) -> DataFrame:
        return frames.settle(cramers_v(crosstabs(self.table)))

    @cached_property
    def skipped_categories(self) -> DataFrame:
        return skipped_categories(self.table)

    @cached_property
    def datetimes(self) -> DataFrame:
        return frames.settle(datetime_profile(self.table))

    @cached_property
    def trends(self) -> DataFrame:
        return frames.settle(time_trends(self.table))

    @property
    def important_relationships(self) -> DataFrame:
        return important_relationships(self.correlation_pairs, self.effects, self.associations, self.trends)

    @property
    def flags(self) -> DataFrame:
        return eda_flags(self.overview, self.missing, self.numeric, self.categorical)

    @property
    def chart_recommendations(self) -> DataFrame:
        return chart_recommendations(self.table, self.correlation_pairs, self.effects, self.trends)


def explore(df: DataFrame, types: Mapping | Profile, row_key: Sequence[str] = ()) -> EdaReport:
    if df.isEmpty():
        raise ValueError("cannot explore an empty table")
    return EdaReport(Table(df, types, row_key))
