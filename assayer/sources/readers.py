"""File scans: CSV and Excel, with the guards a first look at a file needs."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayer.functions import stats
from assayer.operators import frames
from assayer.sources import quoted

# Cell text that a CSV scan reads as missing.
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"
ANY_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
BOOLEAN_WORD = r"^([Tt]rue|TRUE|[Ff]alse|FALSE)$"


def load_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                 multiline: bool | None = None) -> DataFrame:
    """Read a CSV or Excel file (or folder or glob of them) into a typed table.

    Raises for an unknown extension, a missing path and a file without rows.
    """
    extension = PurePosixPath(path.rstrip("/")).suffix.lower()
    if extension not in (".csv", ".xlsx", ".xls"):
        raise ValueError(f"unsupported file type {extension!r}; use .csv, .xlsx or .xls")
    try:
        df = (read_csv(spark, path, schema, multiline) if extension == ".csv"
              else read_excel(spark, path))
        empty = df.isEmpty()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise
    if empty:
        raise ValueError(f"{path} has no rows")
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             multiline: bool | None = None) -> DataFrame:
    """CSV with a header row. Without a schema, one extra pass types the columns.

    Line breaks inside quotes are found by a first look and read in splits (see
    ``quoted``). ``multiline=False`` says that there are none and skips the look,
    ``multiline=True`` leaves such files to Spark's own reader, one task per file.
    """
    if multiline is None and quoted.has_open_lines(spark, path):
        raw = quoted.read(spark, path)
        if schema is not None:
            fields = (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).fields
            cells = zip(fields, raw.columns)
            return frames.nan_to_null(raw.select(*[
                F.when(frames.column(c) != "", frames.column(c)).try_cast(f.dataType).alias(f.name) for f, c in cells]))
    else:
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", bool(multiline))
        if schema is not None:
            return frames.nan_to_null(reader.schema(schema).csv(path))
        raw = reader.option("inferSchema", False).csv(path)
    return infer_physical_types(raw.select(*[
        F.when(~frames.column(c).isin(list(CSV_MISSING)), frames.column(c)).alias(c) for c in raw.columns
    ]))


def infer_physical_types(df: DataFrame) -> DataFrame:
    """Cast text columns whose every value is whole, numeric or true/false; one aggregate decides.

    Whole numbers beyond 64 bits stay text, for a double would merge different ones.
    """
    names = [c for c in df.columns if frames.is_text(df, c)]
    if not names:
        return df
    exprs = []
    for i, c in enumerate(names):
        col = frames.column(c)
        exprs += [F.count(col).alias(f"n{i}"), F.count(F.lit(1)).alias(f"r{i}"),
                  stats.count_if(col.rlike(WHOLE_NUMBER)).alias(f"w{i}"),
                  stats.count_if(col.rlike(WHOLE_NUMBER) & F.btrim(col).try_cast("long").isNull()).alias(f"big{i}"),
                  stats.count_if(col.rlike(ANY_NUMBER)).alias(f"f{i}"),
                  stats.count_if(col.rlike(BOOLEAN_WORD)).alias(f"b{i}")]
    got = df.agg(*exprs).first()
    casts = {}
    for i, c in enumerate(names):
        n = got[f"n{i}"]
        if n and got[f"big{i}"]:
            continue
        if n and got[f"w{i}"] == n:
            casts[c] = "long"
        elif not n or got[f"f{i}"] == n:
            casts[c] = "double"
        elif got[f"b{i}"] == got[f"r{i}"]:
            casts[c] = "boolean"
    return df.withColumns({c: F.btrim(frames.column(c)).try_cast(kind) for c, kind in casts.items()}) if casts else df


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of Excel files, one task per file. Needs a spreadsheet library on the executors.

    The columns come from the first file; all files must share them.
    """
    import pandas as pd

    try:
        import openpyxl  # noqa: F401
    except ImportError as error:
        raise ImportError("reading Excel files needs the openpyxl package") from error
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                names = pd.read_excel(io.BytesIO(content), nrows=0).columns
                yield pd.DataFrame({"names": [json.dumps([str(n) for n in names])]})

    first = files.orderBy("path").limit(1).mapInPandas(headers, "names string").first()
    if first is None:
        raise FileNotFoundError(path)
    names = json.loads(first["names"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                sheet = pd.read_excel(io.BytesIO(content), dtype=object)
                yield sheet[names].astype(object).apply(
                    lambda col: col.map(lambda v: None if pd.isna(v) else str(v)))

    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return infer_physical_types(files.mapInPandas(rows, schema))


def with_row_key(parquet: DataFrame, name: str = "row_key") -> DataFrame:
    """Add a stable row key to a frame read straight from Parquet files: file name and row index."""
    key = F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string"))
    return parquet.select("*", key.alias(name))
