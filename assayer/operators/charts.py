"""Chart data: the aggregates behind every chart kind, candidate ranking and query-result charts.

Drawing is left to the caller; a chart is a spec row and a data frame.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import cached_property, partial
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions import dates, stats, text
from assayer.operators import eda, frames, quantiles
from assayer.operators.anomalies import Table
from assayer.operators.profile import Profile

# Fixed limits and base scores of the automatic charts.
MAX_CATEGORIES, MAX_CHARTS, MAX_POINTS, MIN_CORRELATION = 15, 10, 500, 0.30
MAX_LISTED_OUTLIERS = 100
MIN_BINS, MAX_BINS = 5, 20
NUMERIC_SHARE = 0.60
AXIS_DATE_SHARE = 0.80
BASE_SCORES = {
    "category_distribution": 58, "numeric_distribution": 52, "numeric_box": 45, "correlation_heatmap": 72,
    "scatter": 65, "category_numeric": 68, "grouped_box": 64, "stacked_bar": 66, "time_series": 82,
}
ROW_LEVEL_KINDS = ("box", "violin", "histogram", "scatter", "heatmap")
MISSING_LABEL = "Missing"

SPEC_FIELDS = ("chart_type string, x string, y string, color string, family string, signature string, "
               "score double, intent string")


class Chart:
    """What to draw: kind and axes, and the aggregated rows, which are built when first asked for."""

    def __init__(self, chart_type: str, x: str | None, y: str | None, data: DataFrame | Callable[[], DataFrame],
                 color: str | None = None, score: float = 0.0, signature: tuple = (), intent: str | None = None,
                 value: object = None):
        self.chart_type, self.x, self.y, self.color = chart_type, x, y, color
        self.score, self.signature, self.intent, self.value = score, signature, intent, value
        self._data = data

    @cached_property
    def data(self) -> DataFrame:
        return self._data() if callable(self._data) else self._data


def label(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(MISSING_LABEL))


# -- column tests -----------------------------------------------------------------

def numeric_columns(df: DataFrame) -> list[str]:
    """Columns that are numeric, or text of which at least 60 % of the values parse."""
    found = [c for c in df.columns if text.is_numeric(frames.dtype(df, c))]
    texts = [c for c in df.columns if frames.is_text(df, c)]
    if texts:
        got = df.agg(*[
            stats.ratio(F.count(text.to_number(frames.column(c), frames.dtype(df, c))), F.count(frames.column(c)))
            .alias(f"r{i}") for i, c in enumerate(texts)
        ]).first()
        found += [c for i, c in enumerate(texts) if got[i] >= NUMERIC_SHARE]
    return [c for c in df.columns if c in found]


def column_groups(df: DataFrame, types: Mapping | Profile | None = None) -> dict[str, list[str]]:
    """Columns by semantic type; without one, by physical type (temporal, numeric test, else text)."""
    table = Table(df, types)
    untyped = [c for c in table.columns if c not in table.types]
    numeric = numeric_columns(df.select(*[frames.column(c) for c in untyped])) if untyped else []
    groups: dict[str, list[str]] = {k: [] for k in
                                    ("Numerical", "Categorical", "Datetime", "Boolean", "Identifier", "Text")}
    for c in table.columns:
        kind = table.types.get(c)
        if kind is None:
            temporal = text.is_temporal(frames.dtype(df, c))
            kind = "Datetime" if temporal else "Numerical" if c in numeric else "Text"
        groups[kind if kind in groups else "Text"].append(c)
    return groups


def usable_category_columns(table: Table, names: Sequence[str]) -> dict[str, int]:
    """Columns with 2 to 15 distinct values, with their count."""
    few = [c for c in names if table.approx[c] <= MAX_CATEGORIES * 2]
    exact = table.distinct_counts(few)
    return {c: exact[c] for c in few if 2 <= exact[c] <= MAX_CATEGORIES}


def date_axis(df: DataFrame, x: str) -> DataFrame:
    """Order a line's rows by date when at least 80 % of the x values parse as one."""
    parsed = dates.to_datetime(frames.column(x), frames.dtype(df, x))
    share = df.agg(stats.ratio(F.count(parsed), F.count(F.lit(1)))).first()[0]
    if share < AXIS_DATE_SHARE:
        return df
    return df.withColumn(x, parsed).where(frames.column(x).isNotNull()).orderBy(frames.column(x))


# -- data of one chart --------------------------------------------------------------

def category_frequency(df: DataFrame, category: str, limit: int = MAX_CATEGORIES) -> DataFrame:
    """Rows per category, NULL as 'Missing', most frequent first, top 15."""
    return (
        df.groupBy(label(frames.column(category)).alias(category))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), frames.column(category))
        .limit(limit)
    )


def histogram(table: Table | DataFrame, name: str) -> DataFrame:
    """``(bin_index, left, right, bin, frequency)``: right-closed equal-width bins, empty ones kept.

    As many bins as the square root of the number of values, within 5 and 20;
    the lowest edge is moved out by 0.1 % of the range. One bin if all values
    are equal.
    """
    table = Table.of(table)
    x = table.number(name)
    low, high, n = table.df.agg(F.min(x), F.max(x), F.count(x)).first()
    spark = table.df.sparkSession
    fields = "bin_index int, left double, right double, bin string"
    if not n:
        return frames.local_rows(spark, [], f"{fields}, frequency long")
    if low == high:
        one = frames.local_rows(spark, [(0, low, high, str(round(low, 2)))], fields)
        return one.withColumn("frequency", F.lit(n).cast("long"))
    bins = min(MAX_BINS, max(MIN_BINS, math.isqrt(n)))
    width = (high - low) / bins
    edges = [low + i * width for i in range(bins)] + [high]
    lowest = low - (high - low) * 0.001
    rows = [
        (i, lowest if i == 0 else edges[i], edges[i + 1],
         f"{lowest if i == 0 else edges[i]:.2f} - {edges[i + 1]:.2f}")
        for i in range(bins)
    ]
    counts = (
        table.df.select(stats.right_closed_bin(x, low, width, bins).alias("bin_index"))
        .where(F.col("bin_index").isNotNull())
        .groupBy("bin_index").agg(F.count(F.lit(1)).alias("frequency"))
    )
    return frames.local_rows(spark, rows, fields).join(F.broadcast(counts), "bin_index", "left").select(  # 20 rows
        "bin_index", "left", "right", "bin", F.coalesce("frequency", F.lit(0)).alias("frequency")
    ).orderBy("bin_index")


def box_stats(table: Table | DataFrame, name: str, order_key: Sequence[str] = ()) -> DataFrame:
    """One row: five-number summary, 1.5x IQR fences, outlier count, the first 100 outliers.

    'First' means by the row key when there is one, else by value.
    """
    table = Table.of(table)
    x = table.number(name)
    quartiles = quantiles.column_quantiles(table.df, {name: x}, [0.25, 0.5, 0.75])[name]
    if quartiles is None:
        return frames.local_rows(table.df.sparkSession, [], "column string, min double")
    q1, median, q3 = quartiles
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    outside = (x < F.lit(low)) | (x > F.lit(high))
    got = table.df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), stats.count_if(outside).alias("n")).first()
    order = [frames.column(k) for k in (order_key or table.row_key)] or [x]
    first = [r[0] for r in table.df.where(outside).orderBy(*order).limit(MAX_LISTED_OUTLIERS).select(x).collect()]
    row = {"column": name, "min": got["lo"], "q1": q1, "median": median, "q3": q3, "max": got["hi"],
           "lower_bound": low, "upper_bound": high, "outliers": first, "outlier_count": got["n"]}
    return frames.report(table.df.sparkSession, [row],
                         "column string, min double, q1 double, median double, q3 double, max double, "
                         "lower_bound double, upper_bound double, outliers array<double>, outlier_count long")


def box_by_group(table: Table | DataFrame, category: str, name: str, color: str | None = None) -> DataFrame:
    """Five-number summary and count per group, computed in Spark instead of shipping raw rows."""
    table = Table.of(table)
    keys = [category, color] if color else [category]
    rows = table.df.select(*[label(table.ref(k)).alias(k) for k in keys], table.number(name).alias("x")).where(
        F.col("x").isNotNull())
    counts = rows.groupBy(*[frames.column(k) for k in keys]).agg(
        F.count("x").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"))
    quartiles = quantiles.grouped_quantiles(rows, keys, ["x"], [0.25, 0.5, 0.75]).drop("item")
    return counts.join(quartiles, keys).select(
        *keys, "count", "min", F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("median"),
        F.col("quantiles")[2].alias("q3"), "max",
    ).orderBy(*[frames.column(k) for k in keys])


def scatter_sample(df: DataFrame, x: str, y: str, order_key: Sequence[str], color: str | None = None,
                   limit: int = MAX_POINTS) -> DataFrame:
    """The first 500 rows, by the order key, in which both values are present."""
    px, py = (text.to_number(frames.column(c), frames.dtype(df, c)) for c in (x, y))
    colors = [label(frames.column(color)).alias(color)] if color else []
    return (
        df.where(px.isNotNull() & py.isNotNull())
        .orderBy(*[frames.column(k) for k in order_key])
        .limit(limit)
        .select(px.alias(x), py.alias(y), *colors)
    )


def category_numeric(table: Table | DataFrame, category: str, name: str) -> DataFrame:
    """Mean, median and count of a number per category."""
    table = Table.of(table)
    rows = table.df.select(label(table.ref(category)).alias(category), table.number(name).alias("x")).where(
        F.col("x").isNotNull())
    means = rows.groupBy(frames.column(category)).agg(F.avg("x").alias("mean"), F.count("x").alias("count"))
    medians = quantiles.grouped_quantiles(rows, [category], ["x"], [0.5]).drop("item")
    return means.join(medians, category).select(
        category, "mean", F.col("quantiles")[0].alias("median"), "count").orderBy(frames.column(category))


def group_mean_variation(means: DataFrame, mean: str = "mean") -> DataFrame:
    """One row: spread of the group means relative to their mean, at most 1."""
    spread = F.abs(F.max(mean) - F.min(mean))
    level = F.abs(F.avg(mean))
    value = F.when(F.count(mean) < 2, 0.0).when(level <= 1e-12, F.least(F.lit(1.0), spread)).otherwise(
        F.least(F.lit(1.0), F.try_divide(spread, level)))
    return means.agg(value.alias("mean_variation"))


def composition(df: DataFrame, category: str, color: str) -> DataFrame:
    """Row counts for every combination of two categories."""
    return df.groupBy(
        label(frames.column(category)).alias(category), label(frames.column(color)).alias(color)
    ).agg(F.count(F.lit(1)).alias("count")).orderBy(frames.column(category), frames.column(color))


def time_series(table: Table | DataFrame, date_column: str, name: str) -> DataFrame:
    """Mean of a number per timestamp, in time order."""
    table = Table.of(table)
    return (
        table.df.select(table.date(date_column).alias(date_column), table.number(name).alias(name))
        .where(frames.column(date_column).isNotNull() & frames.column(name).isNotNull())
        .groupBy(frames.column(date_column)).agg(F.avg(frames.column(name)).alias(name))
        .orderBy(frames.column(date_column))
    )


def heatmap(table: Table | DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(x, y, correlation)`` for numeric columns with at least two distinct values."""
    table = Table.of(table)
    if columns is None:
        names = eda.usable_numeric(table, minimum=2)
    else:
        names = eda.usable_numeric(Table(table.df, {c: "Numerical" for c in columns}), minimum=2)
    pairs = frames.settle(eda.correlation_pairs(Table(table.df, {c: "Numerical" for c in names}), columns=names))
    return eda.correlation_matrix(pairs, names, digits=4)


def matrix_pivot(cells: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Long cells to a matrix: one row per ``row`` value, one column per ``col`` value.

    For report-sized cells, such as a correlation matrix: the labels become column names.
    """
    labels = [r[0] for r in cells.select(col).distinct().orderBy(col).collect()]
    return cells.groupBy(row).pivot(col, labels).agg(F.first(value)).orderBy(row)


def strongest_pair(pairs: DataFrame) -> DataFrame:
    """The pair with the largest absolute correlation."""
    return pairs.orderBy(F.desc(F.abs("correlation")), "column_1", "column_2").limit(1).select(
        F.col("column_1").alias("x"), F.col("column_2").alias("y"), F.round("correlation", 4).alias("correlation"))


def category_bar(df: DataFrame, x: str, y: str, order_key: Sequence[str] = (), limit: int = MAX_CATEGORIES) -> DataFrame:
    """Bar of a number per category: as given when categories are unique, else mean per category, top 15."""
    rows = df.select(
        label(frames.column(x)).alias(x), text.to_number(frames.column(y), frames.dtype(df, y)).alias(y),
        *[frames.column(k).alias(f"__{i}") for i, k in enumerate(order_key)],
    ).where(frames.column(y).isNotNull())
    groups = rows.groupBy(frames.column(x)).agg(F.avg(frames.column(y)).alias(y), F.count(F.lit(1)).alias("n"))
    if groups.where(F.col("n") > 1).isEmpty():
        order = [F.col(f"__{i}") for i in range(len(order_key))] or [frames.column(x)]
        return rows.orderBy(*order).limit(limit).select(x, y)
    return groups.orderBy(F.desc(y), frames.column(x)).limit(limit).select(x, y)


# -- automatic charts ------------------------------------------------------------------

def select_best(candidates: DataFrame, limit: int = MAX_CHARTS) -> DataFrame:
    """Candidates by score, one per signature, the best ten.

    ``candidates`` is a spec table (report-sized) with ``score``, ``signature``
    and ``place``, the order of creation that breaks ties.
    """
    once = Window.partitionBy("signature").orderBy(F.desc("score"), "place")
    return (
        candidates.withColumn("nth", F.row_number().over(once)).where(F.col("nth") == 1).drop("nth")
        .orderBy(F.desc("score"), "place").limit(limit)
    )


def chart_candidates(table: Table, order_key: Sequence[str] = ()) -> list[Chart]:
    """Every chart the table supports, scored. Data frames stay lazy.

    The statistics behind the scores (pair correlations, group means, outlier
    counts) are one job per family, not one per chart.
    """
    df, groups = table.df, column_groups(table.df.select(*map(frames.column, table.columns)), table.types)
    keys = list(order_key or table.row_key)
    numbers = eda.usable_numeric(table, minimum=2)
    categories = groups["Categorical"] + groups["Boolean"]
    usable = usable_category_columns(table, categories)
    charts: list[Chart] = []

    def add(kind: str, family: str, names: Sequence[str], data: Callable[[], DataFrame], x: str | None, y: str | None,
            bonus: float = 0.0, color: str | None = None, intent: str = "") -> None:
        charts.append(Chart(kind, x, y, data, color, BASE_SCORES[family] + bonus, (family, *names), intent))

    for c, n in usable.items():
        add("bar", "category_distribution", [c], partial(category_frequency, df, c), c, "count",
            8 if n <= 8 else 0, intent="distribution")
    for c in numbers:
        add("histogram", "numeric_distribution", [c], partial(histogram, table, c), "bin", "frequency", intent="distribution")
    outliers = {r["column"]: r["outlier_count"] for r in _listed_outliers(table, numbers)}
    for c in numbers:
        add("box", "numeric_box", [c], partial(box_stats, table, c, keys), c, c,
            min(20.0, outliers.get(c, 0) / 5), intent="outlier")

    # Correlations here do not use EDA's column limit, only its batches.
    pairs = eda.correlation_pairs(table, columns=numbers).collect() if len(numbers) > 1 else []
    if len(numbers) > 1:
        best = max((abs(p["correlation"]) for p in pairs), default=0.0)
        add("heatmap", "correlation_heatmap", [], partial(heatmap, table, numbers), "x", "y",
            round(best, 4) * 15, intent="correlation")
    place = {c: i for i, c in enumerate(numbers)}
    pairs.sort(key=lambda p: (-abs(p["correlation"]), place[p["column_1"]], place[p["column_2"]]))
    for p in pairs[:3]:
        if abs(p["correlation"]) >= MIN_CORRELATION and keys:
            x, y = p["column_1"], p["column_2"]
            add("scatter", "scatter", [x, y], partial(scatter_sample, df, x, y, keys), x, y,
                abs(p["correlation"]) * 25, intent="relationship")

    numerical = groups["Numerical"]
    for (c, x), variation in _mean_variations(table, list(usable), numerical).items():
        if variation is not None:
            add("bar", "category_numeric", [c, x], partial(category_numeric, table, c, x), c, "mean",
                min(15.0, variation * 15), intent="comparison")
    for c in usable:
        for x in numerical:
            add("box", "grouped_box", [c, x], partial(box_by_group, table, c, x), c, x, intent="group_distribution")
    for a, b in combinations(usable, 2):
        add("stacked_bar", "stacked_bar", [a, b], partial(composition, df, a, b), a, "count", color=b, intent="composition")
    several = {r["column"] for r in _date_facts(table, groups["Datetime"]) if r["lo"] != r["hi"]}
    for d in groups["Datetime"]:
        for x in numerical if d in several else []:
            add("line", "time_series", [d, x], partial(time_series, table, d, x), d, x, intent="temporal")
    return charts


def _listed_outliers(table: Table, numbers: Sequence[str]) -> list:
    """Outliers per column as the box chart lists them (100 at most)."""
    if not numbers:
        return []
    metrics = {}
    for c in numbers:
        q1, _, q3 = table.quartiles[c]
        x, low, high = table.number(c), q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        metrics[c] = {"outlier_count": F.least(
            F.lit(MAX_LISTED_OUTLIERS), stats.count_if((x < F.lit(low)) | (x > F.lit(high))))}
    return frames.aggregate_columns(table.df, metrics).collect()


def _mean_variations(table: Table, categories: Sequence[str], numbers: Sequence[str]) -> dict[tuple, float | None]:
    if not categories or not numbers:
        return {}
    cells = [F.struct(F.lit(c).alias("category_column"), label(table.ref(c)).alias("category")) for c in categories]
    long = table.df.select(*[table.number(x).alias(f"x{i}") for i, x in enumerate(numbers)], F.inline(F.array(*cells)))
    means = long.groupBy("category_column", "category").agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(numbers))])
    out: dict[tuple, float | None] = {}
    by_column = means.groupBy("category_column").agg(*[
        F.struct(F.count(f"x{i}"), F.min(f"x{i}"), F.max(f"x{i}"), F.avg(f"x{i}")).alias(f"x{i}")
        for i in range(len(numbers))
    ]).collect()
    found = {r["category_column"]: r for r in by_column}
    for c in categories:
        for i, x in enumerate(numbers):
            n, low, high, mean = found[c][f"x{i}"]
            if 2 <= n <= MAX_CATEGORIES:
                spread = high - low
                out[(c, x)] = min(1.0, spread) if abs(mean) <= 1e-12 else min(1.0, spread / abs(mean))
            else:
                out[(c, x)] = None
    return out


def _date_facts(table: Table, names: Sequence[str]) -> list:
    if not names:
        return []
    return frames.aggregate_columns(table.df, {
        c: {"lo": F.min(table.date(c)), "hi": F.max(table.date(c))} for c in names
    }).collect()


def spec_table(table: Table, charts: Sequence[Chart]) -> DataFrame:
    rows = [
        {"place": i, "chart_type": c.chart_type, "x": c.x, "y": c.y, "color": c.color, "family": c.signature[0],
         "signature": "|".join(c.signature), "score": round(float(c.score), 3), "intent": c.intent}
        for i, c in enumerate(charts)
    ]
    return frames.report(table.df.sparkSession, rows, f"place int, {SPEC_FIELDS}")


def automatic_charts(df: DataFrame | Table, types: Mapping | Profile | None = None, row_key: Sequence[str] = (),
                     max_charts: int = MAX_CHARTS) -> list[Chart]:
    """The best charts of a table, highest score first."""
    table = Table.of(df, types, row_key)
    charts = chart_candidates(table)
    chosen = select_best(spec_table(table, charts), max_charts)
    return [charts[r["place"]] for r in chosen.collect()]


# -- charts of a query result --------------------------------------------------------------

def chart_source(result: DataFrame, source: DataFrame | None, kind: str | None) -> DataFrame:
    """Row-level kinds read the source table when there is one, the others the query result."""
    if kind in ROW_LEVEL_KINDS and source is not None and not source.isEmpty():
        return source
    return result


def result_chart(result: DataFrame, kind: str | None = None, x: str | None = None, y: str | None = None,
                 color: str | None = None, source: DataFrame | None = None,
                 types: Mapping | Profile | None = None, order_key: Sequence[str] = ()) -> Chart | None:
    """Chart for a query result: the given kind, or line, bar, scatter, frequency by its columns.

    A single value becomes a KPI. Columns not given are chosen by position.
    None when the result does not support the chart.
    """
    head = result.limit(2).collect()
    if not head:
        return None
    if kind is None and len(head) == 1 and len(result.columns) == 1:
        return Chart("kpi", result.columns[0], None, result, intent="summary", value=head[0][0])
    df = chart_source(result, source, kind)
    groups = column_groups(df, types if df is source else None)
    numbers, moments = groups["Numerical"], groups["Datetime"]
    if df is source:
        others = groups["Categorical"] + groups["Boolean"]
    else:
        others = [c for c in df.columns if c not in numbers and c not in moments]
    table = Table(df)
    keys = list(order_key)

    if kind in ("box", "violin"):
        metric = y or (numbers[0] if numbers else None)
        if metric is None:
            return None
        data = box_by_group(table, x, metric, color) if x else box_stats(table, metric, keys)
        return Chart(kind, x, metric, data, color)
    if kind == "histogram":
        metric = x or y or (numbers[0] if numbers else None)
        return Chart(kind, "bin", "frequency", histogram(table, metric)) if metric else None
    if kind == "scatter":
        picked = [c for c in (x, y) if c] if x and y else numbers[:2]
        if len(picked) < 2:
            return None
        return Chart(kind, *picked, scatter_sample(df, *picked, keys or picked, color), color)
    if kind == "heatmap":
        return Chart(kind, "x", "y", heatmap(table, numbers)) if len(numbers) > 1 else None
    if kind == "stacked_bar":
        picked = [x, color] if x and color else others[:2]
        if len(picked) < 2:
            return None
        if numbers:
            metric = y or numbers[-1]
            return Chart(kind, picked[0], metric, df.select(*map(frames.column, (*picked, metric))), picked[1])
        return Chart(kind, picked[0], "count", composition(df, *picked), picked[1])
    if kind == "line" or (kind is None and moments and numbers):
        axis = x or next(iter(moments + others), None)
        metric = y or (numbers[0] if numbers else None)
        if axis is None or metric is None:
            return None
        rows = df.select(frames.column(axis), frames.column(metric)).dropna()
        return Chart("line", axis, metric, rows.orderBy(frames.column(axis)) if axis in moments else date_axis(rows, axis))
    if kind == "bar" or (kind is None and others and numbers):
        axis = x or (others[0] if others else None)
        metric = y or (numbers[-1 if kind else 0] if numbers else None)
        if axis is None or metric is None:
            return None
        return Chart("bar", axis, metric, category_bar(df, axis, metric, keys))
    if kind is None and len(numbers) >= 2:
        return Chart("scatter", *numbers[:2], scatter_sample(df, *numbers[:2], keys or numbers[:2]))
    if kind is None and len(df.columns) == 1 and others:
        return Chart("bar", others[0], "count", category_frequency(df, others[0]))
    return None
