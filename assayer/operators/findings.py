"""Statistical findings about a table, summaries of query results, profile context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions import stats, text
from assayer.operators import eda, frames, quantiles
from assayer.operators.anomalies import Table
from assayer.operators.charts import label
from assayer.operators.eda import EdaReport

# Fixed limits and thresholds.
STRONG_SKEW, DOMINANT = 1.0, 70.0
CORRELATION_CUT, STRONG_CORRELATION = 0.5, 0.7

FINDING_FIELDS = "type string, importance string, column string, column_2 string, value double, message string"


def _finding(df: DataFrame, kind: str, importance: Column | str, value: Column, message: Column,
             first: str | None = None, second: str | None = None) -> DataFrame:
    named = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    return df.select(
        F.lit(kind).alias("type"),
        (F.lit(importance) if isinstance(importance, str) else importance).alias("importance"),
        named(first).alias("column"), named(second).alias("column_2"),
        value.cast("double").alias("value"), message.alias("message"),
    )


def statistical_findings(table: Table | DataFrame, quality_score: float | None = None, pairs: int | None = 5) -> DataFrame:
    """Findings as rows: size, missing cells, duplicates, number summaries, skew, dominance, correlation, quality.

    Works on physical types, like the report it feeds: numbers are numeric
    columns, categories are text and boolean columns, all of them. ``pairs`` is
    how many of the strongest correlations are told; None tells all.
    """
    table = Table.of(table)
    df, c = table.df, F.col
    numbers = [n for n in table.columns if text.is_numeric(frames.dtype(df, n))]
    categories = [n for n in table.columns if not text.is_numeric(frames.dtype(df, n))
                  and not text.is_temporal(frames.dtype(df, n))]
    typed = Table(df.select(*map(frames.column, table.columns)), {n: "Numerical" for n in numbers})
    say = lambda form, *cols: F.format_string(form, *map(F.col, cols))

    size = frames.settle(eda.overview(table))
    parts = [
        _finding(size, "dataset_summary", "info", c("rows"), say("%d rows, %d columns", "rows", "columns")),
        _finding(size, "missing_values",
                 F.when(c("total_missing") == 0, "low").when(c("missing_percentage") >= 20, "high").otherwise("medium"),
                 F.round("missing_percentage", 2),
                 say("%d cells missing, %.2f%% of all", "total_missing", "missing_percentage")),
        _finding(size.where(c("duplicate_rows") > 0), "duplicates", "medium", c("duplicate_rows"),
                 say("%d duplicate rows, %.2f%%", "duplicate_rows", "duplicate_percentage")),
    ]
    if numbers:
        shown = numbers
        medians = quantiles.column_quantiles(df, {n: table.number(n) for n in shown}, [0.5], table.approx)
        summary = frames.settle(frames.aggregate_columns(df, {
            n: {"n": F.count(table.number(n)), "mean": F.avg(table.number(n)), "min": F.min(table.number(n)),
                "max": F.max(table.number(n)), "skew": stats.adjusted_skew(table.number(n))}
            for n in shown
        }, constants={n: {"median": F.lit((medians[n] or [None])[0]).cast("double")} for n in shown}).where(c("n") > 0))
        parts.append(_finding(summary, "numeric_summary", "info", F.round("mean", 4),
                              say("%s: %.2f to %.2f, mean %.2f, median %.2f", "column", "min", "max", "mean", "median"),
                              "column"))
        parts.append(_finding(summary.where(F.abs("skew") >= STRONG_SKEW), "skewness", "medium", F.round("skew", 3),
                              F.format_string("%s: skewed to the %s, skewness %.2f", c("column"),
                                              F.when(c("skew") > 0, "right").otherwise("left"), c("skew")), "column"))
    if categories:
        shapes = eda.raw_counts(table, categories).groupBy("column").agg(
            F.sum("n").alias("n"), F.max("n").alias("top"),
            F.min_by("value", F.struct(-c("n"), c("value"))).alias("mode"))
        shapes = shapes.withColumn("share", stats.percent(c("top"), c("n")))
        parts.append(_finding(shapes, "category_distribution",
                              F.when(c("share") >= DOMINANT, "medium").otherwise("info"), F.round("share", 2),
                              say("%s: %s holds %.2f%%", "column", "mode", "share"), "column"))
    if len(numbers) > 1:
        strongest = eda.correlation_pairs(typed, columns=numbers).orderBy(
            F.desc(F.abs("correlation")), "column_1", "column_2").transform(eda.top, pairs)
        strongest = strongest.where(F.abs("correlation") >= CORRELATION_CUT)
        parts.append(_finding(strongest, "correlation",
                              F.when(F.abs("correlation") >= STRONG_CORRELATION, "high").otherwise("medium"),
                              F.round("correlation", 3),
                              say("%s and %s: r = %.2f", "column_1", "column_2", "correlation"),
                              "column_1", "column_2"))
    if quality_score is not None:
        one = df.sparkSession.range(1).select(F.lit(float(quality_score)).alias("score"))
        parts.append(_finding(one, "quality",
                              F.when(c("score") < 60, "high").when(c("score") < 80, "medium").otherwise("low"),
                              F.round("score", 2), say("quality score %.2f of 100", "score")))
    return frames.union_all(parts)


# -- summaries of query results ----------------------------------------------------

SUMMARY_FIELDS = "kind string, rows long, metric string, label string, value double, text string"


def summarize_category_metric(result: DataFrame, category: str, metric: str) -> DataFrame:
    """Rows holding the highest and lowest value of the metric (ties by category)."""
    name, x = frames.column(category).cast("string"), frames.column(metric).cast("double")
    both = F.when(name.isNotNull() & ~F.isnan(x), x)
    got = result.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(both).alias("hi"), F.min_by(name, F.when(both.isNotNull(), F.struct(-both, name))).alias("hi_name"),
        F.min(both).alias("lo"), F.min_by(name, F.when(both.isNotNull(), F.struct(both, name))).alias("lo_name"),
        F.count(both).alias("valid"),
    )
    rows = [F.struct(F.lit("highest").alias("kind"), F.col("hi_name").alias("label"), F.col("hi").alias("value"),
                     F.lit(1).alias("needs")),
            F.struct(F.lit("lowest").alias("kind"), F.col("lo_name").alias("label"), F.col("lo").alias("value"),
                     F.lit(2).alias("needs"))]
    return got.select("rows", "valid", F.inline(F.array(*rows))).where(F.col("valid") >= F.col("needs")).select(
        "kind", "rows", F.lit(metric).alias("metric"), "label", "value",
        F.format_string("%s %s: %s (%s)", F.col("kind"), F.lit(metric), F.col("value").cast("string"), F.col("label"))
        .alias("text"))


def summarize_metric(result: DataFrame, metric: str) -> DataFrame:
    x = frames.column(metric).cast("double")
    got = result.agg(F.count(F.lit(1)).alias("rows"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mid"))
    rows = [F.struct(F.lit(k).alias("kind"), F.col(v).alias("value"))
            for k, v in (("minimum", "lo"), ("maximum", "hi"), ("mean", "mid"))]
    return got.select("rows", F.inline(F.array(*rows))).where(F.col("value").isNotNull()).select(
        "kind", "rows", F.lit(metric).alias("metric"), F.lit(None).cast("string").alias("label"), "value",
        F.format_string("%s of %s: %s", F.col("kind"), F.lit(metric), F.col("value").cast("string")).alias("text"))


def summarize_category(result: DataFrame, category: str) -> DataFrame:
    counts = result.groupBy(label(frames.column(category)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("rows"), F.max("n").cast("double").alias("value"),
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"),
    ).select(F.lit("most_frequent").alias("kind"), "rows", F.lit(category).alias("metric"), "label", "value",
             F.format_string("most frequent %s: %s (%.0f)", F.lit(category), F.col("label"), F.col("value")).alias("text"))


def summarize_result(result: DataFrame) -> DataFrame:
    """What a query result says: a single value, extremes by category, a range, or the top category."""
    spark = result.sparkSession
    head = result.limit(2).collect()
    if not head:
        return frames.local_rows(spark, [("empty", 0, None, None, None, "no matching records")], SUMMARY_FIELDS)
    numbers = [c for c in result.columns if text.is_numeric(frames.dtype(result, c))]
    others = [c for c in result.columns if c not in numbers]
    if len(head) == 1 and len(result.columns) == 1:
        value, name = head[0][0], result.columns[0]
        number = float(value) if numbers and value is not None else None
        shown = None if value is None else str(value)
        return frames.local_rows(spark, [("value", 1, name, shown, number, f"{name}: {shown}")], SUMMARY_FIELDS)
    if others and numbers:
        return summarize_category_metric(result, others[0], numbers[0])
    return summarize_metric(result, numbers[0]) if numbers else summarize_category(result, others[0])


# -- profile context ------------------------------------------------------------------

def relevant_columns(eda_report: EdaReport, columns: Sequence[str]) -> list[str]:
    """The asked-for columns that the exploration report knows, in name order."""
    known = set(eda_report.table.kinds("Numerical", "Categorical", "Boolean", "Datetime"))
    return sorted(known & set(columns))


def profile_context(eda_report: EdaReport, columns: Sequence[str]) -> DataFrame:
    """``(section, column, metric, value)`` of everything the report says about some columns."""
    names = relevant_columns(eda_report, columns)

    def facts(df: DataFrame, section: str, metrics: Mapping[str, str]) -> DataFrame:
        kept = [m for m in metrics if m in df.columns]
        if not kept:
            return frames.local_rows(df.sparkSession, [], "section string, column string, metric string, value string")
        rows = [F.struct(F.lit(metrics[m]).alias("metric"),
                         (F.format_string("%.4f", F.col(m)) if dict(df.dtypes)[m] == "double" else F.col(m).cast("string"))
                         .alias("value")) for m in kept]
        return df.where(F.col("column").isin(names)).select(
            F.lit(section).alias("section"), "column", F.inline(F.array(*rows))).where(F.col("value").isNotNull())

    same = lambda *m: dict(zip(m, m))
    r = F.col("correlation")
    strength = F.when(F.abs(r) >= 0.7, "strong").when(F.abs(r) >= 0.4, "moderate").otherwise("weak")
    direction = F.when(r > 0, "positive").when(r < 0, "negative").otherwise("no")
    pairs = eda_report.correlations.where(F.col("column_1").isin(names) | F.col("column_2").isin(names)).select(
        F.lit("correlation").alias("section"), F.concat_ws(" vs ", "column_1", "column_2").alias("column"),
        F.inline(F.array(
            F.struct(F.lit("value").alias("metric"), F.format_string("%.4f", r).alias("value")),
            F.struct(F.lit("interpretation").alias("metric"), F.concat_ws(" ", strength, direction).alias("value")),
        )),
    )
    top = eda_report.top_categories.where(F.col("column").isin(names)).select(
        F.lit("distribution").alias("section"), "column", F.col("value").alias("metric"), F.col("n").cast("string").alias("value"))
    return frames.union_all([
        facts(eda_report.numeric, "numerical", same("count", "mean", "median", "min", "max", "std")),
        facts(eda_report.categorical, "categorical", same("unique_values", "most_common", "most_common_count")),
        facts(eda_report.numeric, "shape", same("skewness", "distribution_shape")),
        facts(eda_report.datetimes, "datetime", same("valid_dates", "missing_dates", "earliest", "latest", "range_days")),
        top, pairs,
    ])
