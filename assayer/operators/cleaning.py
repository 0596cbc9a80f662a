"""Type-aware cleaning: null text, duplicates, typed values, impossible negatives, imputation.

Outliers are never removed; text, datetimes and identifiers are never filled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer.functions import dates, naming, stats, text, tokens as t
from assayer.operators import frames, quantiles
from assayer.operators.profile import Profile, columns_of, resolve_types

# Fixed thresholds.
SKEW_FOR_MEDIAN = 0.75
FEW_VALUES = 10
MAX_NUMERIC_MISSING = 0.60
MAX_CATEGORY_MISSING, MODE_DOMINANCE = 0.30, 0.40
MAX_BOOLEAN_MISSING, BOOLEAN_DOMINANCE = 0.10, 0.70
HIGH_CARDINALITY, HIGH_CARDINALITY_SHARE = 50, 0.50
UNKNOWN = "Unknown"

LOG_FIELDS = "step int, column string, operation string, count long, strategy string, message string"


@dataclass(frozen=True)
class CleanResult:
    df: DataFrame
    log: DataFrame
    summary: DataFrame


# -- row-level transforms ----------------------------------------------------

def is_null_text(df: DataFrame, name: str) -> Column:
    return text.in_words(frames.column(name), t.CLEANING_NULLS)


def normalize_nulls(df: DataFrame, row_key: Sequence[str] = ()) -> DataFrame:
    """Trim every string cell and turn null-like text into NULL; NaN becomes NULL too."""
    strings = [c for c in df.columns if c not in row_key and frames.is_text(df, c)]
    cleaned = {c: F.when(~is_null_text(df, c), text.trimmed(frames.column(c))) for c in strings}
    return frames.nan_to_null(df).withColumns(cleaned) if cleaned else frames.nan_to_null(df)


def null_text_counts(df: DataFrame, row_key: Sequence[str] = ()) -> DataFrame:
    """``(column, count)`` of null-like text cells per string column."""
    strings = [c for c in df.columns if c not in row_key and frames.is_text(df, c)]
    if not strings:
        return frames.local_rows(df.sparkSession, [], "column string, count long")
    return frames.aggregate_columns(df, {c: {"count": stats.count_if(is_null_text(df, c))} for c in strings})


def repeated_digests(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Digests that two rows and more have: what tells most rows apart from those that may be duplicates."""
    return frames.with_digest(df, columns).groupBy(*frames.DIGEST).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def drop_duplicates(df: DataFrame, row_key: Sequence[str] = (), repeated: DataFrame | None = None) -> DataFrame:
    """One row per distinct record. With a row key, the smallest key of each group stays.

    Rows are compared by digest first. A row whose digest no other row has passes
    through as it is, without a shuffle as long as Spark can broadcast the repeated
    digests (16 bytes each); only rows that share a digest are compared in full,
    combined map-side, so a record repeated a billion times is one row per task.
    ``repeated`` are the digests of :func:`repeated_digests`, if they are known.
    """
    columns = [c for c in df.columns if c not in row_key]
    repeated = frames.stage(repeated_digests(df, columns).select(*frames.DIGEST)) if repeated is None else repeated
    one, two = frames.row_digest([(frames.column(c), frames.dtype(df, c)) for c in columns])
    marked = df.withColumns({frames.DIGEST[0]: one, frames.DIGEST[1]: two})
    on = list(frames.DIGEST)
    single = marked.join(repeated, on, "left_anti").drop(*frames.DIGEST)
    shared = marked.join(repeated, on, "left_semi").drop(*frames.DIGEST)
    if not row_key:
        return single.unionByName(shared.dropDuplicates())
    kept = shared.groupBy(*[frames.column(c) for c in columns]).agg(
        F.min(F.struct(*[frames.column(k) for k in row_key])).alias("__key")
    )
    first = kept.select(*[F.col("__key").getField(c).alias(c) if c in row_key else frames.column(c) for c in df.columns])
    return single.unionByName(first)


def raw_and_normal_digests(raw: DataFrame, row_key: Sequence[str] = ()) -> DataFrame:
    """``(version, digest, n)`` of rows as they came (version 0) and with null-like text settled (1), counted in one pass."""
    columns = [c for c in raw.columns if c not in row_key]
    beside = raw.withColumn("__raw", F.struct(*[frames.column(c).alias(f"c{i}") for i, c in enumerate(columns)]))
    normal = normalize_nulls(beside, [*row_key, "__raw"])
    versions = ([F.col(f"__raw.c{i}") for i in range(len(columns))], [frames.column(c) for c in columns])
    cells = [
        F.struct(F.lit(version).alias("version"), *[d.alias(n) for d, n in zip(
            frames.row_digest([(v, frames.dtype(raw, c)) for v, c in zip(values, columns)]), frames.DIGEST)])
        for version, values in enumerate(versions)
    ]
    return normal.select(F.inline(F.array(*cells))).groupBy("version", *frames.DIGEST).agg(F.count(F.lit(1)).alias("n"))


def to_boolean(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return col
    return (
        F.when(text.in_words(col, t.CLEANING_TRUE), F.lit(True))
        .when(text.in_words(col, t.CLEANING_FALSE), F.lit(False))
    )


def typed_column(df: DataFrame, name: str, kind: str | None, date_format: str | None,
                 lenient_numbers: bool) -> Column:
    col, dtype = frames.column(name), frames.dtype(df, name)
    if kind == "Numerical":
        return col if text.is_numeric(dtype) else text.to_number(col, dtype, lenient_numbers)
    if kind == "Datetime":
        return dates.to_datetime(col, dtype, date_format)
    if kind == "Boolean":
        return to_boolean(col, dtype)
    if kind in ("Categorical", "Text") or (kind == "Identifier" and text.is_string(dtype)):
        return text.trimmed(col)
    return col


def to_typed(df: DataFrame, types: Mapping[str, str], date_formats: Mapping[str, str | None] | None = None,
             lenient_numbers: bool = False) -> DataFrame:
    """Cast every column to its semantic type in one projection; what does not fit becomes NULL."""
    formats = date_formats or {}
    return df.select(*[
        typed_column(df, c, types.get(c), formats.get(c), lenient_numbers).alias(c) for c in df.columns
    ])


def null_negatives(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Negative values of Numerical columns whose name says they cannot be negative become NULL."""
    suspects = [c for c in columns_of(types, "Numerical") if naming.negatives_are_suspicious(c)]
    return df.withColumns(
        {c: F.when(~(frames.column(c) < 0), frames.column(c)) for c in suspects}
    ) if suspects else df


# -- imputation ---------------------------------------------------------------

def choose_numeric_fill(facts: Mapping) -> tuple[str, float]:
    """Strategy and value from count, min, max, skew, mean and median of the valid values."""
    if facts["valid"] == 1:
        return "single_value", facts["min"]
    if facts["min"] == facts["max"]:
        return "constant", facts["min"]
    if abs(facts["skew"] or 0.0) > SKEW_FOR_MEDIAN or facts["valid"] < FEW_VALUES:
        return "median", facts["median"]
    return "mean", facts["mean"]


def choose_category_fill(facts: Mapping) -> tuple[str, str]:
    valid, unique = facts["valid"], facts["unique"]
    if not valid or (unique > HIGH_CARDINALITY and unique / valid > HIGH_CARDINALITY_SHARE):
        return UNKNOWN, UNKNOWN
    if facts["missing"] / facts["rows"] > MAX_CATEGORY_MISSING:
        return UNKNOWN, UNKNOWN
    if facts["top"] / valid >= MODE_DOMINANCE:
        return "mode", facts["mode"]
    return UNKNOWN, UNKNOWN


def fill_facts(df: DataFrame, types: Mapping[str, str]) -> dict[str, dict]:
    """What the fill rules need, for columns with missing values: at most three jobs."""
    metrics = {}
    for c in df.columns:
        if c not in types:
            continue
        col, kind = frames.column(c), types[c]
        numeric = kind == "Numerical"
        x = col.cast("double") if numeric else F.lit(None).cast("double")
        yes = stats.count_if(col == F.lit(True)) if kind == "Boolean" else F.lit(0).cast("long")
        metrics[c] = {
            "rows": F.count(F.lit(1)), "valid": F.count(col), "yes": yes,
            "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "skew": stats.adjusted_skew(x),
        }
    if not metrics:
        return {}
    facts = {r["column"]: r.asDict() for r in frames.aggregate_columns(df, metrics).collect()}
    for f in facts.values():
        f["missing"] = f["rows"] - f["valid"]
    gaps = {c: f for c, f in facts.items() if f["missing"]}
    need_median = {c: frames.column(c).cast("double") for c in columns_of(types, "Numerical")
                   if c in gaps and gaps[c]["valid"]}
    for c, q in quantiles.column_quantiles(df, need_median, [0.5]).items():
        facts[c]["median"] = q[0]
    need_mode = [c for c in columns_of(types, "Categorical") if c in gaps]
    if need_mode:
        counts = frames.value_counts(df, {c: frames.column(c) for c in need_mode})
        shapes = counts.groupBy("column").agg(
            F.count(F.lit(1)).alias("unique"), F.max("n").alias("top"),
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
        )
        for c in need_mode:
            facts[c] |= {"unique": 0, "top": 0, "mode": None}
        for r in shapes.collect():
            facts[r["column"]] |= r.asDict()
    return facts


def choose_fills(facts: Mapping[str, Mapping], types: Mapping[str, str]) -> dict[str, tuple[str, object]]:
    """``{column: (strategy, value)}``; strategy ``keep`` leaves the column as it is."""
    fills = {}
    for c, f in facts.items():
        if not f["missing"]:
            continue
        kind, share = types.get(c), f["missing"] / f["rows"]
        if kind == "Numerical" and f["valid"] and share <= MAX_NUMERIC_MISSING:
            fills[c] = choose_numeric_fill(f)
        elif kind == "Categorical":
            fills[c] = choose_category_fill(f)
        elif kind == "Boolean" and f["valid"] and share <= MAX_BOOLEAN_MISSING \
                and max(f["yes"], f["valid"] - f["yes"]) / f["valid"] >= BOOLEAN_DOMINANCE:
            fills[c] = ("mode", f["yes"] > f["valid"] - f["yes"])
        else:
            fills[c] = ("keep", None)
    return fills


def apply_fills(df: DataFrame, fills: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Fill every column in one projection; whole-number columns take fractions as double."""
    filled = {}
    for c, (strategy, value) in fills.items():
        if strategy == "keep":
            continue
        col, dtype = frames.column(c), frames.dtype(df, c)
        whole = isinstance(value, float) and value.is_integer()
        if text.is_numeric(dtype) and not whole:
            dtype = T.DoubleType()
        filled[c] = F.coalesce(col.cast(dtype), F.lit(value).cast(dtype))
    return df.withColumns(filled) if filled else df


def fill_table(df: DataFrame, facts: Mapping, fills: Mapping, types: Mapping) -> DataFrame:
    rows = [
        {"column": c, "detected_type": types.get(c), "missing": facts[c]["missing"], "strategy": s,
         "fill_value": None if v is None else str(v).lower() if isinstance(v, bool) else str(v)}
        for c, (s, v) in fills.items()
    ]
    return frames.report(df.sparkSession, rows,
                         "column string, detected_type string, missing long, strategy string, fill_value string")


# -- the whole pipeline -----------------------------------------------------------

def _missing_cells(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [stats.count_if(frames.column(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)]


def clean(df: DataFrame, types: Mapping | Profile | None = None, row_key: Sequence[str] = (),
          lenient_numbers: bool = False) -> CleanResult:
    """Clean a table: null text, duplicates, types, negatives, missing values, in this order.

    The deduplicated, typed table is staged once; the statistics and the result
    are read from there. ``lenient_numbers`` also accepts currency marks,
    thousands separators and percent signs.
    """
    columns = frames.analysed_columns(df, row_key)
    formats = types.date_formats if isinstance(types, Profile) else {}
    kinds = {c: k for c, k in resolve_types(df, types).items() if c in columns}
    log: list[dict] = []

    def note(column: str | None, operation: str, count: int, message: str, strategy: str | None = None) -> None:
        log.append({"step": len(log) + 1, "column": column, "operation": operation, "count": count,
                    "strategy": strategy, "message": message})

    # Before: rows, missing cells and null text in one pass; duplicates of the raw rows in another.
    strings = [c for c in columns if frames.is_text(df, c)]
    raw = frames.nan_to_null(df)
    before = raw.agg(
        F.count(F.lit(1)).alias("rows"), *_missing_cells(raw, columns),
        *[stats.count_if(is_null_text(df, c)).alias(f"t{i}") for i, c in enumerate(strings)],
    ).first()
    if before["rows"] == 0:
        raise ValueError("cannot clean an empty table")
    distinct_rows = lambda frame: frames.with_digest(frame, columns).distinct().count()
    repeated = frames.stage(raw_and_normal_digests(raw, row_key).where("n > 1"))
    raw_duplicates = repeated.where("version = 0").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    null_text = {c: before[f"t{i}"] for i, c in enumerate(strings)}
    for c, n in null_text.items():
        if n:
            note(c, "null_normalization", n, f"{n} null-like value(s) in {c} set to missing")

    normalized = normalize_nulls(df, row_key)
    unique = drop_duplicates(normalized, row_key, repeated.where("version = 1").select(*frames.DIGEST))
    # Raw and typed values side by side: the casts are counted and staged together.
    casts = to_typed(unique, kinds, formats, lenient_numbers)
    failed = {
        c: F.col("__lost").getItem(i) for i, c in enumerate(columns)
    }
    lost = F.array(*[
        (frames.column(c).isNotNull()
         & typed_column(unique, c, kinds.get(c), formats.get(c), lenient_numbers).isNull()).cast("int")
        for c in columns
    ])
    staged = frames.stage(unique.select(
        *[typed_column(unique, c, kinds.get(c), formats.get(c), lenient_numbers).alias(c) for c in casts.columns],
        lost.alias("__lost"),
    ))
    typed = staged.drop("__lost")
    cleaned = null_negatives(typed, kinds)
    counted = staged.agg(
        F.count(F.lit(1)).alias("rows"), *_missing_cells(typed, columns),
        *[F.coalesce(F.sum(failed[c]), F.lit(0)).alias(f"f{i}") for i, c in enumerate(columns)],
    ).first()
    removed = before["rows"] - counted["rows"]
    if removed:
        note(None, "duplicate_removal", removed, f"{removed} duplicate row(s) removed")
    operations = {"Numerical": ("numeric_conversion", "number"), "Datetime": ("invalid_datetime", "datetime"),
                  "Boolean": ("invalid_boolean", "boolean")}
    for i, c in enumerate(columns):
        kind, n = kinds.get(c), counted[f"f{i}"]
        if kind == "Datetime":
            note(c, "datetime_conversion", counted["rows"], f"{c} converted to datetime")
        if kind == "Boolean":
            note(c, "boolean_standardization", counted["rows"], f"{c} standardised to boolean")
        if kind in operations and n:
            operation, word = operations[kind]
            note(c, operation, n, f"{n} value(s) in {c} are no {word} and became missing")

    facts = fill_facts(cleaned, kinds)
    negatives = 0
    for i, c in enumerate(columns):
        n = facts[c]["missing"] - counted[f"m{i}"] if c in facts else 0
        negatives += n
        if n:
            note(c, "invalid_negative", n, f"{n} impossible negative value(s) in {c} became missing")
    untyped = {c: counted[f"m{i}"] for i, c in enumerate(columns) if c not in facts}
    before_fill = sum(f["missing"] for f in facts.values()) + sum(untyped.values())
    fills = choose_fills(facts, kinds)
    names = {"Numerical": "numeric_imputation", "Categorical": "categorical_imputation",
             "Boolean": "boolean_imputation"}
    for c, (strategy, value) in fills.items():
        n = facts[c]["missing"]
        if strategy == "keep":
            note(c, "missing_preserved", n, f"{n} missing value(s) in {c} kept")
        else:
            note(c, names[kinds[c]], n, f"{n} missing value(s) in {c} filled, {strategy} = {value}", strategy)
    for c, n in untyped.items():
        if n:
            note(c, "missing_preserved", n, f"{n} missing value(s) in {c} kept")
    result = apply_fills(cleaned, fills)
    filled = sum(facts[c]["missing"] for c, (s, _) in fills.items() if s != "keep")

    summary = {
        "original_rows": before["rows"],
        "final_rows": counted["rows"],
        "rows_removed": removed,
        "original_columns": len(columns),
        "final_columns": len(columns),
        "original_missing_values": sum(before[f"m{i}"] for i in range(len(columns))),
        "normalized_null_like_values": sum(null_text.values()),
        "missing_before_imputation": before_fill,
        "missing_values_filled": filled,
        "remaining_missing_values": before_fill - filled,
        "original_duplicate_rows": raw_duplicates,
        "duplicate_rows_removed": removed,
        "remaining_duplicate_rows": counted["rows"] - distinct_rows(result),
        "invalid_values_converted_to_missing": negatives,
        "outliers_removed": 0,
        "operation_count": len(log),
        "schema_context_used": int(bool(kinds)),
    }
    spark = df.sparkSession
    return CleanResult(
        df=result,
        log=frames.report(spark, log, LOG_FIELDS),
        summary=frames.report(spark, [summary], ", ".join(f"{k} long" for k in summary)),
    )
