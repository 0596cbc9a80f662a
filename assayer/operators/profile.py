"""Semantic schema inference: what each column means, from its values and its name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from assayer.functions import dates, naming, stats, text, tokens as t
from assayer.operators import frames, quantiles

TOP_VALUES = 10
# Fixed thresholds of the type cascade.
MIN_ID_VALUES, ID_UNIQUE, ID_STRUCTURED, SERIAL_UNIQUE = 5, 0.95, 0.8, 0.98
DATE_NAMED, DATE_UNNAMED, NUMBER_PARSED = 0.90, 0.98, 0.95
LONG_TEXT = 40
UNIQUE_CUTS = (0.05, 0.20, ID_UNIQUE, SERIAL_UNIQUE)
# An approximate distinct count this close to a threshold is replaced by the exact one.
APPROX_MARGIN = 0.25

PROFILE_SCHEMA = (
    "column string, physical_type string, detected_type string, missing long, non_null long, "
    "unique long, missing_ratio double, unique_ratio double, null_like_count long, "
    "null_like_ratio double, null_like_values array<string>, numeric_parse_ratio double, "
    "datetime_parse_ratio double, date_format string, average_text_length double, "
    "min double, max double, mean double, median double, std double, "
    "date_min string, date_max string, top_values map<string,bigint>"
)


class Profile:
    """Semantic schema of a table: one record per column, kept on the driver."""

    def __init__(self, spark: SparkSession, rows: int, records: Sequence[dict], counted_exactly: bool = True):
        self.spark, self.rows, self.records = spark, rows, list(records)
        self.counted_exactly = counted_exactly

    @property
    def types(self) -> dict[str, str]:
        return {r["column"]: r["detected_type"] for r in self.records}

    @property
    def exact_unique(self) -> dict[str, int]:
        """Distinct counts, if all of them were counted exactly."""
        return {r["column"]: r["unique"] for r in self.records} if self.counted_exactly else {}

    @property
    def date_formats(self) -> dict[str, str | None]:
        return {r["column"]: r["date_format"] for r in self.records}

    def to_df(self) -> DataFrame:
        return frames.report(self.spark, self.records, PROFILE_SCHEMA)

    def columns_by_type(self) -> DataFrame:
        """One row per semantic type with its columns in table order; empty types included."""
        rows = [
            {"detected_type": kind, "columns": [c for c, k in self.types.items() if k == kind]}
            for kind in t.SEMANTIC_TYPES
        ]
        return frames.report(self.spark, rows, "detected_type string, columns array<string>")


def resolve_types(df: DataFrame, types: Mapping | Profile | None) -> dict[str, str]:
    """Normalise a caller's schema to ``{column: canonical type}``.

    Accepts a Profile, ``{column: name}`` or ``{column: {"semantic_type" | "detected_type": name}}``,
    with the usual aliases in any case. Unknown names stay as they are.
    """
    if types is None:
        return {}
    if isinstance(types, Profile):
        types = types.types
    canonical = {alias: kind for kind, aliases in t.TYPE_ALIASES.items() for alias in aliases}
    resolved = {}
    for name, given in types.items():
        if isinstance(given, Mapping):
            given = given.get("semantic_type") or given.get("detected_type")
        if given is not None and name in df.columns:
            resolved[name] = canonical.get(str(given).strip().lower(), str(given))
    return resolved


def columns_of(types: Mapping[str, str], *kinds: str) -> list[str]:
    return [c for c, kind in types.items() if kind in kinds]


def _text_metrics(value: Column, low: Column) -> dict[str, Column]:
    """What the cascade needs to know about a string column, given trimmed and folded text."""
    return {
        "words": F.bool_and(low.isin(list(t.SCHEMA_TRUE + t.SCHEMA_FALSE))),
        "has_true": F.bool_or(low.isin(list(t.SCHEMA_TRUE))),
        "has_false": F.bool_or(low.isin(list(t.SCHEMA_FALSE))),
        "null_like": stats.count_if(low.isin(list(t.SCHEMA_NULLS))),
        "numbers": F.count(text.text_to_number(value)),
        "amounts": F.count(text.to_number(value, T.StringType(), lenient=True)),
        "structured": stats.count_if(value.rlike(text.STRUCTURED_ID)),
        "length": F.avg(F.char_length(value)),
        "date_like": stats.count_if(value.rlike(dates.DATE_LIKE)),
    }


def _date_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, int]]:
    """Values each date format parses, for the columns that hold date-like text at all."""
    if not columns:
        return {}
    texts = df.select(*[
        F.when(text.trimmed(frames.column(c)).rlike(dates.DATE_LIKE), text.trimmed(frames.column(c))).alias(f"t{i}")
        for i, c in enumerate(columns)
    ])
    exprs = []
    for i in range(len(columns)):
        value = F.col(f"t{i}")
        exprs += [F.count(dates.parse_format(value, f)) for f in dates.DATE_FORMATS]
        exprs.append(F.count(dates.parse_mixed(value)))
    got = list(texts.agg(*[e.alias(f"m{k}") for k, e in enumerate(exprs)]).first())
    width = len(dates.DATE_FORMATS) + 1
    names = [*[f"date{i}" for i in range(width - 1)], "date_mixed"]
    return {c: dict(zip(names, got[i * width:(i + 1) * width])) for i, c in enumerate(columns)}


def date_format_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, format, parsed)``: how many values each date format parses."""
    names = [f.label for f in dates.DATE_FORMATS] + [dates.MIXED]
    rows = [(c, name, n) for c, counts in _date_counts(df, columns).items() for name, n in zip(names, counts.values())]
    return frames.local_rows(df.sparkSession, rows, "column string, format string, parsed long")


def _other_metrics(col: Column, dtype: T.DataType) -> dict[str, Column]:
    metrics = {"length": F.avg(F.char_length(col.cast("string")))}
    if text.is_integer(dtype):
        metrics |= {
            "words": F.bool_and(col.isin(0, 1)),
            "has_true": F.bool_or(col == 1),
            "has_false": F.bool_or(col == 0),
        }
    return metrics


def _counts(col: Column) -> dict[str, Column]:
    return {"non_null": F.count(col), "approx": F.approx_count_distinct(col)}


def choose_date_format(got: Mapping, non_null: int) -> tuple[float, str | None]:
    """Best single format (the earlier wins a tie, a near-full match stops the search).

    Mixed parsing is considered only when no single format covers 80 %.
    """
    if not non_null or got["numbers"] / non_null >= 0.95:
        return 0.0, None
    best, label = 0.0, None
    for i, fmt in enumerate(dates.DATE_FORMATS):
        share = got[f"date{i}"] / non_null
        if share > best:
            best, label = share, fmt.label
        if share >= 0.95:
            break
    if best < 0.8 and got["date_mixed"] / non_null > best:
        best, label = got["date_mixed"] / non_null, dates.MIXED
    return best, label


def is_categorical(unique: int, non_null: int) -> bool:
    if not non_null:
        return False
    share = unique / non_null
    return unique <= 20 or (unique <= 100 and share <= 0.20) or (non_null >= 50 and share <= 0.05)


def looks_like_identifier(unique: int, non_null: int, structured: int, integer: bool) -> bool:
    if non_null < MIN_ID_VALUES or unique / non_null < ID_UNIQUE:
        return False
    return integer or structured / non_null >= ID_STRUCTURED


def detect_type(name: str, dtype: T.DataType, facts: Mapping) -> str:
    """The type cascade: the first rule that fits decides."""
    non_null, unique = facts["non_null"], facts["unique"]
    if non_null == 0:
        return "Empty"
    if isinstance(dtype, T.BooleanType):
        return "Boolean"
    if facts.get("words") and facts.get("has_true") and facts.get("has_false"):
        return "Boolean"
    if naming.is_identifier_name(name):
        return "Identifier"
    if text.is_temporal(dtype):
        return "Datetime"
    if text.is_numeric(dtype):
        serial = naming.has_serial_name(name) and unique / non_null >= SERIAL_UNIQUE
        integer = text.is_integer(dtype) and facts["non_null"] == facts["rows"]
        structured = non_null if integer else 0
        return "Identifier" if serial and looks_like_identifier(unique, non_null, structured, integer) else "Numerical"
    if facts["datetime_ratio"] >= DATE_NAMED and naming.has_date_name(name):
        return "Datetime"
    if facts["datetime_ratio"] >= DATE_UNNAMED:
        return "Datetime"
    if facts["numeric_ratio"] >= NUMBER_PARSED:
        return "Numerical"
    if naming.has_text_name(name) or facts["length"] >= LONG_TEXT:
        return "Text"
    if is_categorical(unique, non_null):
        return "Categorical"
    if looks_like_identifier(unique, non_null, facts["structured"], False):
        return "Identifier"
    return "Text"


def _near_a_threshold(approx: int, non_null: int) -> bool:
    if not non_null or approx <= 200:
        return True
    share = approx / non_null
    return any(abs(share - cut) <= APPROX_MARGIN * cut for cut in UNIQUE_CUTS)


def schema_profile(df: DataFrame, row_key: Sequence[str] = (), exact_unique: bool = True) -> Profile:
    """Profile every column: counts, parse ratios, semantic type and a summary by type.

    At most seven queries whatever the number of columns: one wide aggregate, one
    for date formats (date-like columns only), one for distinct counts, one for the summaries, one for medians, one for top
    values. ``exact_unique=False`` reports approximate distinct counts where no
    type decision is near, which drops the one shuffle that grows with the table.
    """
    columns = frames.analysed_columns(df, row_key)
    refs = {c: frames.column(c) for c in columns}
    dtypes = {c: frames.dtype(df, c) for c in columns}

    # Trimmed and folded text is computed once per value, in a projection of its own.
    # Text columns are one row per cell: generated for each of them, the expressions would be too much code to compile.
    exprs, places = [F.count(F.lit(1)).alias("rows")], {}
    texts = [c for c in columns if text.is_string(dtypes[c])]
    for i, c in enumerate(columns):
        if c not in texts:
            metrics = _other_metrics(refs[c], dtypes[c]) | _counts(refs[c])
            places[c] = list(metrics)
            exprs += [e.alias(f"c{i}_{m}") for m, e in metrics.items()]
    wide = df.agg(*exprs).first()
    rows = wide["rows"]
    if rows == 0:
        raise ValueError("cannot profile an empty table")
    facts = {c: {m: wide[f"c{i}_{m}"] for m in places[c]} | {"rows": rows} for i, c in enumerate(columns) if c in places}
    if texts:
        cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("column"), refs[c].cast("string").alias("v")) for i, c in enumerate(texts)])))
        cells = cells.select("column", "v", text.trimmed(F.col("v")).alias("t"), text.folded(F.col("v")).alias("f"))
        metrics = _text_metrics(F.col("t"), F.col("f")) | _counts(F.col("v"))
        for r in cells.groupBy("column").agg(*[e.alias(m) for m, e in metrics.items()]).collect():
            facts[texts[r["column"]]] = {m: r[m] for m in metrics} | {"rows": rows}

    for c, counts in _date_counts(df, [c for c in columns if facts[c].get("date_like")]).items():
        facts[c] |= counts
    exact = [c for c in columns if exact_unique or _near_a_threshold(facts[c]["approx"], facts[c]["non_null"])]
    exact_counts = frames.exact_distincts(df, {c: refs[c] for c in exact})
    for c in columns:
        facts[c]["unique"] = exact_counts.get(c, facts[c]["approx"])
        settle_type(c, dtypes[c], facts[c])

    kinds = {c: facts[c]["type"] for c in columns}
    summaries = _summaries(df, dtypes, kinds, {c: facts[c].get("date_format") for c in columns})
    medians = quantiles.column_quantiles(
        df,
        {c: text.to_number(refs[c], dtypes[c], lenient=True) for c in columns_of(kinds, "Numerical")},
        [0.5],
        {c: facts[c]["approx"] for c in columns},
    )
    tops = _top_values(df, columns_of(kinds, "Categorical", "Boolean"), TOP_VALUES)
    marks = _null_like_values(df, [c for c in columns if facts[c].get("null_like")])

    records = [
        record(c, dtypes[c], facts[c], marks.get(c, []), (medians.get(c) or [None])[0], tops.get(c), summaries.get(c, {}))
        for c in columns
    ]
    return Profile(df.sparkSession, rows, records, exact_unique)


def settle_type(name: str, dtype: T.DataType, f: dict) -> None:
    """Put parse ratios, date format and detected type to a column's counts."""
    if text.is_string(dtype):
        f["numeric_ratio"] = stats_ratio(f["amounts"], f["non_null"])
        f["datetime_ratio"], f["date_format"] = choose_date_format(f, f["non_null"]) if f["date_like"] else (0.0, None)
    else:
        numeric = text.is_numeric(dtype)
        f["numeric_ratio"] = 1.0 if numeric and f["non_null"] else 0.0
        f["datetime_ratio"] = 1.0 if text.is_temporal(dtype) and f["non_null"] else 0.0
    f["type"] = detect_type(name, dtype, f)


def record(name: str, dtype: T.DataType, f: Mapping, marks: Sequence[str], median: float | None,
           top: Mapping[str, int] | None, summary: Mapping) -> dict:
    """One column's entry of a profile, from its counts and its detected type."""
    rows = f["rows"]
    return {
        "column": name,
        "physical_type": dtype.simpleString(),
        "detected_type": f["type"],
        "missing": rows - f["non_null"],
        "non_null": f["non_null"],
        "unique": f["unique"],
        "missing_ratio": round((rows - f["non_null"]) / rows, 4),
        "unique_ratio": round(stats_ratio(f["unique"], f["non_null"]), 4),
        "null_like_count": f.get("null_like", 0) or 0,
        "null_like_ratio": round((f.get("null_like", 0) or 0) / rows, 4),
        "null_like_values": list(marks),
        "numeric_parse_ratio": round(f["numeric_ratio"], 4),
        "datetime_parse_ratio": round(f["datetime_ratio"], 4),
        "date_format": f.get("date_format") if f["type"] == "Datetime" else None,
        "average_text_length": round(f["length"] or 0.0, 2),
        "median": median,
        "top_values": top,
        **summary,
    }


def stats_ratio(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


def _summaries(df: DataFrame, dtypes: Mapping, kinds: Mapping[str, str],
               formats: Mapping[str, str | None]) -> dict[str, dict]:
    exprs, fields = [], []
    for i, c in enumerate(kinds):
        if kinds[c] == "Numerical":
            x = text.to_number(frames.column(c), dtypes[c], lenient=True)
            parts = {"min": F.min(x), "max": F.max(x), "mean": F.avg(x),
                     "std": F.when(F.count(x) > 1, F.stddev_samp(x)).when(F.count(x) == 1, 0.0)}
        elif kinds[c] == "Datetime":
            d = dates.to_datetime(frames.column(c), dtypes[c], formats[c])
            parts = {"date_min": dates.iso(F.min(d)), "date_max": dates.iso(F.max(d))}
        else:
            continue
        for name, e in parts.items():
            exprs.append(e.alias(f"s{i}_{name}"))
            fields.append((c, name, f"s{i}_{name}"))
    out: dict[str, dict] = {}
    if exprs:
        got = df.agg(*exprs).first()
        for c, name, alias in fields:
            out.setdefault(c, {})[name] = got[alias]
    return out


def top_values(df: DataFrame, columns: Sequence[str], limit: int = TOP_VALUES) -> DataFrame:
    """``(column, value, n, place)``: the most frequent values, ties by value.

    The rank filter is pushed below the shuffle as a per-task group limit, so a
    column with many values does not land in one task.
    """
    counts = frames.value_counts(df, {c: frames.column(c) for c in columns})
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def _top_values(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, dict[str, int]]:
    if not columns:
        return {}
    out: dict[str, dict[str, int]] = {c: {} for c in columns}
    for row in sorted(top_values(df, columns, limit).collect(), key=lambda r: r["place"]):
        out[row["column"]][row["value"]] = row["n"]
    return out


def null_like_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, value, n)`` of text that stands for missing, per trimmed spelling."""
    names = [c for c in (columns or df.columns) if frames.is_text(df, c)]
    if not names:
        return frames.empty_counts(df.sparkSession)
    marked = {
        c: F.when(text.in_words(frames.column(c), t.SCHEMA_NULLS), text.trimmed(frames.column(c)))
        for c in names
    }
    return frames.value_counts(df, marked)


def _null_like_values(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    if not columns:
        return {}
    # A fixed word list in upper or lower case: the groups are bounded by its spellings.
    found: dict[str, list] = {}
    for row in null_like_values(df, columns).orderBy("column", F.desc("n"), "value").collect():
        found.setdefault(row["column"], []).append(row["value"])
    return {c: values[:TOP_VALUES] for c, values in found.items()}
