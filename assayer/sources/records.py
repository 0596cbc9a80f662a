"""Row output as JSON-safe records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer.functions import dates, text
from assayer.operators import frames


def _safe(df: DataFrame, name: str) -> Column:
    col, dtype = frames.column(name), frames.dtype(df, name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), col)
    if isinstance(dtype, T.DateType):
        return dates.iso(col.cast("timestamp_ntz"))
    return dates.iso(col) if text.is_temporal(dtype) else col


def to_records(df: DataFrame) -> DataFrame:
    """One ``record`` string per row: every field kept, timestamps in ISO form, NaN and infinity as null."""
    fields = F.struct(*[_safe(df, c).alias(c) for c in df.columns])
    return df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("record"))


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines, written by the executors."""
    to_records(df).write.mode("overwrite").text(path)
