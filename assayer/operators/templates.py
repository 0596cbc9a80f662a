"""Query templates with explicit columns: the deterministic questions one asks of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from assayer.operators import frames

PROJECTION_LIMIT, PREVIEW_LIMIT = 5000, 100
SAMPLE_VALUES = 5


def quote(name: str, mark: str = "`") -> str:
    """Quote an identifier for SQL text; Spark uses backticks, ANSI engines double quotes."""
    return mark + name.replace(mark, mark * 2) + mark


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*map(frames.column, columns))


def total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(frames.column(column)).distinct().orderBy(frames.column(column))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(frames.column(column)).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"))


def average_by(df: DataFrame, group: str, metric: str) -> DataFrame:
    name = f"average_{metric}"
    return df.groupBy(frames.column(group)).agg(F.avg(frames.column(metric)).alias(name)).orderBy(
        frames.column(name).desc())


def average(df: DataFrame, metric: str) -> DataFrame:
    return df.agg(F.avg(frames.column(metric)).alias(f"average_{metric}"))


def maximum(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(frames.column(column)).alias(f"maximum_{column}"))


def minimum(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(frames.column(column)).alias(f"minimum_{column}"))


def project_some(df: DataFrame, columns: Sequence[str], limit: int = PROJECTION_LIMIT) -> DataFrame:
    return project(df, columns).limit(limit)


def preview(df: DataFrame, limit: int = PREVIEW_LIMIT) -> DataFrame:
    return df.limit(limit)


def schema_context(df: DataFrame, values: int = SAMPLE_VALUES) -> DataFrame:
    """``(column, type, samples)``: the smallest distinct values of each column, as text, over the whole table.

    One aggregate for each value finds the next larger one of every column, so
    nothing is shuffled but one row per task.
    """
    found: dict[str, list[str]] = {c: [] for c in df.columns}
    for n in range(values):
        alive = [c for c in df.columns if len(found[c]) == n]
        if not alive:
            break
        texts = {c: frames.column(c).cast("string") for c in alive}
        row = df.agg(*[
            F.min(F.when(texts[c] > found[c][-1], texts[c]) if found[c] else texts[c]).alias(f"v{i}") for i, c in enumerate(alive)
        ]).first()
        for i, c in enumerate(alive):
            if row[f"v{i}"] is not None:
                found[c].append(row[f"v{i}"])
    return frames.local_rows(df.sparkSession, [(c, t, found[c]) for c, t in df.dtypes], "column string, type string, samples array<string>")
