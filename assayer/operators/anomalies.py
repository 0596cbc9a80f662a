"""Outliers, rare values, identifier, datetime, missingness, variance and duplicate anomalies."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions import dates, stats, text, tokens as t
from assayer.operators import frames, quantiles
from assayer.operators.profile import Profile, columns_of, resolve_types

# Fixed thresholds.
OUTLIER_IQR, EXTREME_IQR = 1.5, 3.0
MIN_NUMERIC_VALUES = 4
RARE_SHARE, RARE_COUNT = 0.01, 5
HIGH_MISSING, SOME_MISSING = 50.0, 20.0
NEAR_CONSTANT = 0.95
# A near-constant column has at most 5 % + 1 distinct values; twice that share
# leaves room for the error of the approximate count.
NEAR_CONSTANT_DISTINCT_SHARE = 0.10

# Stands for a column where a row's digest is counted among the values of columns.
WHOLE_ROW = "\x00row"

ISSUE_FIELDS = "type string, column string, severity string, message string"


class Table:
    """A table with its semantic types, and the per-column numbers operators share.

    Everything here is at most one row per column; rows stay in Spark.
    """

    def __init__(self, df: DataFrame, types: Mapping | Profile | None = None,
                 row_key: Sequence[str] = ()):
        self.df, self.row_key = df, list(row_key)
        self.columns = frames.analysed_columns(df, row_key)
        self.types = {c: k for c, k in resolve_types(df, types).items() if c in self.columns}
        self.date_formats = types.date_formats if isinstance(types, Profile) else {}
        self._known_unique = dict(types.exact_unique) if isinstance(types, Profile) else {}
        self._known_approx: dict[str, int] = {}
        self._exprs: dict[tuple[str, str], Column] = {}

    @classmethod
    def of(cls, table: "Table | DataFrame", types: Mapping | Profile | None = None,
           row_key: Sequence[str] = ()) -> "Table":
        return table if isinstance(table, Table) else cls(table, types, row_key)

    def kinds(self, *names: str) -> list[str]:
        return [c for c in self.columns if self.types.get(c) in names]

    def _expr(self, kind: str, name: str, build: Callable[[], Column]) -> Column:
        # Expressions are immutable and costly to build from Python, so each is built once.
        if (kind, name) not in self._exprs:
            self._exprs[kind, name] = build()
        return self._exprs[kind, name]

    def ref(self, name: str) -> Column:
        return self._expr("ref", name, lambda: frames.column(name))

    def missing(self, name: str) -> Column:
        return self._expr("missing", name, lambda: text.missing_like(
            self.ref(name), frames.dtype(self.df, name), t.REPORT_NULLS))

    def present(self, name: str) -> Column:
        return self._expr("present", name, lambda: F.when(~self.missing(name), self.ref(name)))

    def number(self, name: str) -> Column:
        return self._expr("number", name, lambda: text.to_number(self.ref(name), frames.dtype(self.df, name)))

    def finite(self, name: str) -> Column:
        return self._expr("finite", name, lambda: text.finite(self.number(name)))

    def date(self, name: str) -> Column:
        return self._expr("date", name, lambda: dates.to_datetime(self.ref(name), frames.dtype(self.df, name)))

    @cached_property
    def unique_counts(self) -> dict[str, int]:
        """Exact distinct non-null values per column; taken over from a profile that counted them."""
        return self.distinct_counts(self.columns)

    def distinct_counts(self, names: Sequence[str]) -> dict[str, int]:
        """Exact distinct counts of some columns, each counted once."""
        todo = [c for c in names if c not in self._known_unique]
        self._known_unique |= frames.exact_distincts(self.df, {c: self.ref(c) for c in todo})
        return {c: self._known_unique[c] for c in names}

    @cached_property
    def finite_ranges(self) -> dict[str, tuple]:
        """``(count, min, max)`` of the finite values of every Numerical column."""
        names = self.kinds("Numerical")
        if not names:
            return {}
        got = frames.aggregate_columns(self.df, {
            c: {"n": F.count(self.finite(c)), "lo": F.min(self.finite(c)), "hi": F.max(self.finite(c))} for c in names
        }).collect()
        return {r["column"]: (r["n"], r["lo"], r["hi"]) for r in got}

    @cached_property
    def _scan(self) -> tuple[int, dict, dict]:
        return frames.approx_distincts(self.df, {c: self.present(c) for c in self.columns})

    @property
    def rows(self) -> int:
        return self._scan[0]

    @property
    def valid_counts(self) -> dict[str, int]:
        return self._scan[1]

    @property
    def approx(self) -> dict[str, int]:
        return self._scan[2]

    def approx_counts(self, names: Sequence[str]) -> dict[str, int]:
        """Approximate distinct counts of some columns; the others are not read unless they were counted already."""
        if "_scan" in self.__dict__:
            return {c: self.approx[c] for c in names}
        todo = [c for c in names if c not in self._known_approx]
        if todo:
            self._known_approx |= frames.approx_distincts(self.df, {c: self.present(c) for c in todo})[2]
        return {c: self._known_approx[c] for c in names}

    @cached_property
    def quartiles(self) -> dict[str, list[float]]:
        """Exact q1, median, q3 of every Numerical column that has values."""
        names = self.kinds("Numerical")
        found = quantiles.column_quantiles(
            self.df, {c: self.number(c) for c in names}, [0.25, 0.5, 0.75], self.approx
        )
        return {c: q for c, q in found.items() if q}

    @cached_property
    def frequencies(self) -> DataFrame:
        """Staged ``(column, value, n)`` that reports, scores and row evidence share: one pass, one shuffle.

        Categories and columns that one value may fill are there in full. Of
        identifiers and of whole rows (WHOLE_ROW, by digest) only what repeats is.
        """
        full = list(dict.fromkeys(self.kinds("Categorical", "Boolean") + low_variance_suspects(self)[1]))
        names = list(dict.fromkeys(full + self.kinds("Identifier")))
        counts = frames.value_counts(self.df, {c: self.present(c) for c in names} | {WHOLE_ROW: self.row_digest})
        return frames.stage(counts.where((F.col("n") > 1) | F.col("column").isin(full)))

    @property
    def row_digest(self) -> Column:
        return F.concat_ws(":", *frames.row_digest([(self.ref(c), frames.dtype(self.df, c)) for c in self.columns]))

    @cached_property
    def cell_counts(self) -> DataFrame:
        """Settled counts of every column's cells in one pass: missing, invalid, padded, outlying."""
        checked, none = set(checked_numeric(self)), F.lit(0).cast("long")
        metrics = {}
        for c in self.columns:
            x, f = self.number(c), _fences(self.quartiles[c]) if c in checked else None
            metrics[c] = plain_counts(self, c) | {
                "values_checked": F.count(x) if f else none,
                "outliers": stats.count_if(_outside(x, f["lo"], f["hi"], f["iqr"])) if f else none,
                "extreme_outliers": stats.count_if(_outside(x, f["xlo"], f["xhi"], f["iqr"])) if f else none,
                "invalid_dates": stats.count_if(invalid_date(self, c)) if self.types.get(c) == "Datetime" else none,
            }
        return frames.settle(frames.aggregate_columns(self.df, metrics))

    @cached_property
    def duplicate_summary(self) -> DataFrame:
        """One settled row: rows, duplicate_rows, duplicate_percentage, affected_rows."""
        got = self.frequencies.where(F.col("column") == WHOLE_ROW).agg(F.sum(F.col("n") - 1), F.sum("n")).first()
        surplus, affected = got[0] or 0, got[1] or 0
        share = F.round(stats.percent(F.lit(surplus).cast("long"), F.lit(self.rows).cast("long")), 2)
        row = frames.local_rows(self.df.sparkSession, [(self.rows, surplus, affected)], "rows long, duplicate_rows long, affected_rows long")
        return frames.settle(row.select("rows", "duplicate_rows", share.alias("duplicate_percentage"), "affected_rows"))


def plain_counts(table: Table, name: str) -> dict[str, Column]:
    """Cells of one column that are missing, don't fit its type, or are padded text."""
    padded = ~table.missing(name) & (table.ref(name).cast("string") != text.trimmed(table.ref(name)))
    return {
        "rows": F.count(F.lit(1)), "missing_values": stats.count_if(table.missing(name)),
        "invalid_values": stats.count_if(invalid(table, name)),
        "padded": stats.count_if(padded) if table.types.get(name) == "Text" else F.lit(0).cast("long"),
    }


def invalid(table: Table, name: str) -> Column:
    """A value is present and doesn't fit the column's type."""
    kind, present = table.types.get(name), ~table.missing(name)
    if kind == "Numerical":
        return present & table.number(name).isNull()
    if kind == "Datetime":
        return present & table.date(name).isNull()
    if kind == "Boolean":
        return present & ~text.in_words(table.ref(name), t.VALID_BOOLEANS)
    return present & (text.trimmed(table.ref(name)) == "")


# -- duplicates ------------------------------------------------------------

def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Complete duplicates: surplus rows, their share, and all rows in a duplicate group. Rows are compared by digest."""
    groups = frames.with_digest(df, columns or df.columns).groupBy(*frames.DIGEST).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("affected_rows"),
    ).select(
        "rows", "duplicate_rows",
        F.round(stats.percent(F.col("duplicate_rows"), F.col("rows")), 2).alias("duplicate_percentage"),
        "affected_rows",
    )


# -- numeric outliers --------------------------------------------------------

def _fences(q: Sequence[float]) -> dict[str, float]:
    q1, _, q3 = q
    spread = q3 - q1
    if spread == 0:
        return {"lo": q1, "hi": q3, "xlo": q1, "xhi": q3, "iqr": 0.0}
    return {
        "lo": q1 - OUTLIER_IQR * spread, "hi": q3 + OUTLIER_IQR * spread,
        "xlo": q1 - EXTREME_IQR * spread, "xhi": q3 + EXTREME_IQR * spread, "iqr": spread,
    }


def _outside(x: Column, low: float, high: float, iqr: float) -> Column:
    return F.lit(False) if iqr == 0 else (x < F.lit(low)) | (x > F.lit(high))


def checked_numeric(table: Table) -> list[str]:
    return [c for c in table.quartiles if table.valid_counts[c] >= MIN_NUMERIC_VALUES]


def numeric_outliers(table: Table | DataFrame, types: Mapping | None = None) -> DataFrame:
    """Per numeric column: quartiles, 1.5x and 3x IQR fences and the values beyond them.

    A column with IQR 0 is reported with no outliers; one with fewer than four
    values is left out.
    """
    table = Table.of(table, types)
    metrics, fences = {}, {}
    for c in table.quartiles:
        x, f = table.number(c), _fences(table.quartiles[c])
        q1, median, q3 = table.quartiles[c]
        metrics[c] = {
            "values_checked": F.count(x),
            "outliers": stats.count_if(_outside(x, f["lo"], f["hi"], f["iqr"])),
            "extreme_outliers": stats.count_if(_outside(x, f["xlo"], f["xhi"], f["iqr"])),
        }
        fences[c] = {
            k: F.round(F.lit(float(v)), 2) for k, v in (
                ("q1", q1), ("median", median), ("q3", q3), ("iqr", f["iqr"]),
                ("lower_bound", f["lo"]), ("upper_bound", f["hi"]),
                ("extreme_lower_bound", f["xlo"]), ("extreme_upper_bound", f["xhi"]),
            )
        }
    if not metrics:
        return frames.local_rows(table.df.sparkSession, [], OUTLIER_FIELDS)
    return (
        frames.aggregate_columns(table.df, metrics, constants=fences)
        .where(F.col("values_checked") >= MIN_NUMERIC_VALUES)
        .select(
            "column", "values_checked", "outliers", "extreme_outliers",
            F.round(stats.percent(F.col("outliers"), F.col("values_checked")), 2).alias("outlier_percentage"),
            "q1", "median", "q3", "iqr", "lower_bound", "upper_bound", "extreme_lower_bound", "extreme_upper_bound",
        )
    )


OUTLIER_FIELDS = (
    "column string, values_checked long, outliers long, extreme_outliers long, "
    "outlier_percentage double, q1 double, median double, q3 double, iqr double, "
    "lower_bound double, upper_bound double, extreme_lower_bound double, extreme_upper_bound double"
)


def outlier_totals(outliers: DataFrame) -> DataFrame:
    """Totals over all numeric columns; constant-spread columns count in the denominator."""
    return outliers.agg(
        F.coalesce(F.sum("values_checked"), F.lit(0)).alias("values_checked"),
        F.coalesce(F.sum("outliers"), F.lit(0)).alias("outliers"),
        F.coalesce(F.sum("extreme_outliers"), F.lit(0)).alias("extreme_outliers"),
    ).withColumn(
        "outlier_percentage", F.round(stats.percent(F.col("outliers"), F.col("values_checked")), 2)
    )


def outlier_values(table: Table | DataFrame, types: Mapping | None = None) -> DataFrame:
    """Every outlying cell as ``(row key..., column, value, extreme)``; no cap."""
    table = Table.of(table, types)
    cells = []
    for c in checked_numeric(table):
        x, f = table.number(c), _fences(table.quartiles[c])
        cells.append(F.when(_outside(x, f["lo"], f["hi"], f["iqr"]), F.struct(
            F.lit(c).alias("column"), x.alias("value"),
            _outside(x, f["xlo"], f["xhi"], f["iqr"]).alias("extreme"),
        )))
    keys = [frames.column(k) for k in table.row_key]
    if not cells:
        empty = F.array().cast("array<struct<column:string,value:double,extreme:boolean>>")
        return table.df.select(*keys, F.inline(empty))
    return table.df.select(*keys, F.inline(F.array_compact(F.array(*cells))))


# -- rare categories ----------------------------------------------------------

def category_counts(table: Table, columns: Sequence[str]) -> DataFrame:
    """Frequency table of raw, non-missing values."""
    if not columns:
        return frames.empty_counts(table.df.sparkSession)
    return frames.value_counts(table.df, {c: table.present(c) for c in columns})


def valid_count(table: Table, columns: Sequence[str]) -> Column:
    """Number of present values of the column a frequency row belongs to, as literals."""
    return F.create_map(*[F.lit(x) for c in columns for x in (c, table.valid_counts[c])])[F.col("column")]


def is_rare(n: Column, total: Column) -> Column:
    return (n <= RARE_COUNT) & (n / total <= RARE_SHARE)


def rare_categories(table: Table | DataFrame, types: Mapping | None = None) -> DataFrame:
    """Rare values of Categorical and Boolean columns: at most 5 rows and at most 1 %."""
    table = Table.of(table, types)
    names = table.kinds("Categorical", "Boolean")
    counts = category_counts(table, names)
    if not names:
        return counts.withColumn("percentage", F.lit(0.0))
    total = valid_count(table, names)
    return counts.where(is_rare(F.col("n"), total)).select(
        "column", "value", "n", F.round(stats.percent(F.col("n"), total), 2).alias("percentage"))


def column_shapes(table: Table, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Per column, from one frequency table: distinct, most frequent, rare and shared values."""
    n = F.col("n")
    rare = is_rare(n, valid_count(table, columns)) if columns else F.lit(False)
    counts = category_counts(table, columns) if counts is None else counts.where(F.col("column").isin(list(columns)))
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"), F.max("n").alias("top"), F.sum("n").alias("total"),
        stats.count_if(rare).alias("rare"), F.coalesce(F.sum(F.when(rare, n)), F.lit(0)).alias("rare_rows"),
        stats.count_if(n > 1).alias("shared"), F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("shared_rows"),
    )


def rare_category_summary(table: Table | DataFrame, types: Mapping | None = None) -> DataFrame:
    table = Table.of(table, types)
    return column_shapes(table, table.kinds("Categorical", "Boolean")).select(
        "column", F.col("distinct").alias("unique_categories"), F.col("rare").alias("rare_category_count"), "rare_rows")


# -- identifiers ---------------------------------------------------------------

def duplicate_identifier_values(table: Table | DataFrame, types: Mapping | None = None) -> DataFrame:
    """``(column, value, n)`` of every identifier value that occurs more than once; no cap."""
    table = Table.of(table, types)
    return category_counts(table, table.kinds("Identifier")).where(F.col("n") > 1)


def identifier_anomalies(table: Table | DataFrame, types: Mapping | None = None) -> DataFrame:
    """Missing identifiers and all rows whose identifier is shared, per Identifier column."""
    table = Table.of(table, types)
    names = table.kinds("Identifier")
    if not names:
        return frames.local_rows(table.df.sparkSession, [], "column string, values_checked long, missing_identifiers long, "
                "duplicate_identifier_values long, duplicate_identifier_rows long")
    missing = frames.aggregate_columns(table.df, {
        c: {"rows": F.count(F.lit(1)), "missing_identifiers": stats.count_if(table.missing(c))} for c in names
    })
    shared = column_shapes(table, names).select(
        "column", F.col("shared").alias("duplicate_identifier_values"),
        F.col("shared_rows").alias("duplicate_identifier_rows"))
    return missing.join(F.broadcast(shared), "column", "left").select(  # one row per column
        "column",
        (F.col("rows") - F.col("missing_identifiers")).alias("values_checked"),
        "missing_identifiers",
        F.coalesce("duplicate_identifier_values", F.lit(0)).alias("duplicate_identifier_values"),
        F.coalesce("duplicate_identifier_rows", F.lit(0)).alias("duplicate_identifier_rows"),
    )


# -- datetimes -------------------------------------------------------------------

def invalid_date(table: Table, name: str) -> Column:
    return ~table.missing(name) & table.date(name).isNull()


def datetime_anomalies(table: Table | DataFrame, types: Mapping | None = None) -> DataFrame:
    """Values of Datetime columns that are present but do not parse, and the date range."""
    table = Table.of(table, types)
    metrics = {
        c: {
            "values_checked": stats.count_if(~table.missing(c)),
            "invalid_dates": stats.count_if(invalid_date(table, c)),
            "minimum_date": dates.iso(F.min(F.when(~table.missing(c), table.date(c)))),
            "maximum_date": dates.iso(F.max(F.when(~table.missing(c), table.date(c)))),
        }
        for c in table.kinds("Datetime")
    }
    if not metrics:
        return frames.local_rows(table.df.sparkSession, [], "column string, values_checked long, invalid_dates long, invalid_percentage double, "
                "minimum_date string, maximum_date string")
    return frames.aggregate_columns(table.df, metrics).select(
        "column", "values_checked", "invalid_dates",
        F.round(stats.percent(F.col("invalid_dates"), F.col("values_checked")), 2).alias("invalid_percentage"),
        "minimum_date", "maximum_date",
    )


# -- missingness -----------------------------------------------------------------

def missing_severity(percentage: Column, missing: Column) -> Column:
    return (
        F.when(percentage >= HIGH_MISSING, "high")
        .when(percentage >= SOME_MISSING, "medium")
        .when(missing > 0, "low")
        .otherwise("none")
    )


def missingness(table: Table | DataFrame, row_key: Sequence[str] = ()) -> DataFrame:
    """Missing or missing-like cells per column, with a severity."""
    table = Table.of(table, None, row_key)
    counted = frames.aggregate_columns(table.df, {
        c: {"rows": F.count(F.lit(1)), "missing_values": stats.count_if(table.missing(c))} for c in table.columns
    })
    share = stats.percent(F.col("missing_values"), F.col("rows"))
    return counted.select(
        "column", "rows", "missing_values", F.round(share, 2).alias("missing_percentage"),
        missing_severity(share, F.col("missing_values")).alias("severity"),
    )


def missing_cells(table: Table) -> Column:
    """Number of missing cells in a row."""
    return reduce(lambda a, b: a + b, [table.missing(c).cast("int") for c in table.columns])


def high_missing_rows(table: Table | DataFrame, row_key: Sequence[str] = ()) -> DataFrame:
    """Rows with at least half of their cells missing."""
    table = Table.of(table, None, row_key)
    share = missing_cells(table) * F.lit(100.0 / len(table.columns))
    return table.df.select(
        *[frames.column(k) for k in table.row_key],
        missing_cells(table).cast("long").alias("missing_columns"),
        F.round(share, 2).alias("missing_percentage"),
    ).where(F.col("missing_columns") * 2 >= len(table.columns))


# -- low variance ------------------------------------------------------------------

def low_variance(table: Table | DataFrame, row_key: Sequence[str] = ()) -> DataFrame:
    """Empty, constant and near-constant columns (one value holds at least 95 %).

    Only columns with few distinct values are counted exactly; the others cannot
    qualify.
    """
    table = Table.of(table, None, row_key)
    spark = table.df.sparkSession
    empty, suspects = low_variance_suspects(table)
    fields = "column string, type string, unique_values long, dominant_percentage double"
    found = frames.local_rows(table.df.sparkSession, [(c, "empty", 0, 0.0) for c in empty], fields)
    if not suspects:
        return found
    shapes = column_shapes(table, suspects)
    return found.unionByName(shapes.where(variance_type().isNotNull()).select(
        "column", variance_type().alias("type"), F.col("distinct").alias("unique_values"),
        F.round(stats.percent(F.col("top"), F.col("total")), 2).alias("dominant_percentage"),
    ))


def low_variance_suspects(table: Table) -> tuple[list[str], list[str]]:
    """Empty columns, and those with few enough values for one of them to dominate."""
    empty = [c for c in table.columns if table.valid_counts[c] == 0]
    return empty, [
        c for c in table.columns
        if c not in empty and table.approx[c] <= NEAR_CONSTANT_DISTINCT_SHARE * table.valid_counts[c] + 2
    ]


def variance_type() -> Column:
    return F.when(F.col("distinct") == 1, "constant").when(
        stats.ratio(F.col("top"), F.col("total")) >= NEAR_CONSTANT, "near_constant")


# -- suspicious rows ---------------------------------------------------------------

def row_issues(table: Table | DataFrame, types: Mapping | None = None, row_key: Sequence[str] = ()) -> DataFrame:
    """``(row key..., column, issue, points)``: which rows are behind each finding, and what they add to a row's score.

    Missing cells, outliers, invalid dates, missing identifiers and mostly empty
    rows are plain projections; missing cells have no points. Rare values, shared
    identifiers and duplicate rows need a count first and then only touch the
    rows concerned.
    """
    table = Table.of(table, types, row_key)
    keys = [frames.column(k) for k in table.row_key]
    found = []

    def note(column: str | None, issue: str, points: int, condition: Column) -> None:
        found.append(F.when(condition, F.struct(
            F.lit(column).cast("string").alias("column"), F.lit(issue).alias("issue"), F.lit(points).cast("long").alias("points"))))

    note(None, "mostly_empty", 2, missing_cells(table) * 2 >= len(table.columns))
    for c in checked_numeric(table):
        x, f = table.number(c), _fences(table.quartiles[c])
        note(c, "outlier", 1, _outside(x, f["lo"], f["hi"], f["iqr"]))
        note(c, "extreme_outlier", 1, _outside(x, f["xlo"], f["xhi"], f["iqr"]))
    for c in table.columns:
        note(c, "missing_cell", 0, table.missing(c))
    for c in table.kinds("Identifier"):
        note(c, "missing_identifier", 2, table.missing(c))
    for c in table.kinds("Datetime"):
        note(c, "invalid_date", 2, invalid_date(table, c))
    parts = [table.df.select(*keys, F.inline(F.array_compact(F.array(*found))))]

    # Rare values, shared identifiers and repeated rows are counted and matched together: a row's digest is one more value of it.
    categories, identifiers = table.kinds("Categorical", "Boolean"), table.kinds("Identifier")
    names = categories + identifiers
    values = {c: table.present(c) for c in names} | {WHOLE_ROW: table.row_digest}
    n, name = F.col("n"), F.col("column")
    wanted = name.isin([*identifiers, WHOLE_ROW]) & (n > 1)
    if categories:
        wanted = wanted | (name.isin(categories) & is_rare(n, valid_count(table, names)))
    cells = frames.long_values(table.df, values, table.row_key).where(F.col("value").isNotNull())
    counts = table.frequencies.where(name.isin(list(values)))
    hits = frames.matching_rows(cells, counts, ["column", "value"], wanted, table.rows)
    kind = F.when(name == WHOLE_ROW, "duplicate_row").when(name.isin(identifiers), "shared_identifier").otherwise("rare_category")
    parts.append(hits.select(
        *keys, F.when(name != WHOLE_ROW, name).alias("column"), kind.alias("issue"), F.lit(1).cast("long").alias("points")))
    return frames.union_all(parts)


def row_evidence(table: Table) -> DataFrame:
    """``(row key..., score)``: one row per piece of evidence that counts against a table row."""
    return row_issues(table).where("points > 0").select(
        *[frames.column(k) for k in table.row_key], F.col("points").alias("score"))


def suspicious_rows(table: Table | DataFrame, types: Mapping | None = None,
                    row_key: Sequence[str] = ()) -> DataFrame:
    """Rows with anomaly evidence: summed score and severity (5 and more high, 3 and more medium)."""
    table = Table.of(table, types, row_key)
    if not table.row_key:
        raise ValueError("suspicious_rows needs a row_key: tables have no row order to refer to")
    return (
        row_evidence(table)
        .groupBy(*table.row_key)
        .agg(F.sum("score").alias("anomaly_score"))
        .withColumn("severity", F.when(F.col("anomaly_score") >= 5, "high")
                    .when(F.col("anomaly_score") >= 3, "medium").otherwise("low"))
        .orderBy(F.desc("anomaly_score"), *table.row_key)
    )


# -- reports -------------------------------------------------------------------------

def column_facts(table: Table | DataFrame, types: Mapping | None = None) -> DataFrame:
    """Every per-column count behind the report: one narrow pass and one frequency table."""
    table = Table.of(table, types)
    facts = table.cell_counts
    categories, identifiers = table.kinds("Categorical", "Boolean"), table.kinds("Identifier")
    empty, suspects = low_variance_suspects(table)
    shapes = column_shapes(table, list(dict.fromkeys(categories + identifiers + suspects)), table.frequencies)
    name = F.col("column")
    count_of = lambda kinds, n: F.when(name.isin(kinds), F.coalesce(n, F.lit(0))).otherwise(0)
    return facts.join(F.broadcast(shapes), "column", "left").select(  # one row per column
        "column", "rows", "missing_values",
        F.round(stats.percent(F.col("missing_values"), F.col("rows")), 2).alias("missing_percentage"),
        "values_checked", "outliers", "extreme_outliers",
        F.round(stats.percent(F.col("outliers"), F.col("values_checked")), 2).alias("outlier_percentage"),
        count_of(categories, F.col("rare")).alias("rare_categories"),
        count_of(identifiers, F.col("missing_values")).alias("missing_identifiers"),
        count_of(identifiers, F.col("shared")).alias("duplicate_identifier_values"),
        count_of(identifiers, F.col("shared_rows")).alias("duplicate_identifier_rows"),
        name.isin(identifiers).alias("is_identifier"),
        "invalid_dates",
        F.when(name.isin(empty), "empty").when(name.isin(suspects), variance_type()).alias("low_variance"),
    )


def column_summary(facts: DataFrame) -> DataFrame:
    """One row per column: issue tags and the count behind each."""
    tags = {
        "missing_values": "missing_values", "numeric_outliers": "outliers",
        "extreme_numeric_outliers": "extreme_outliers", "rare_categories": "rare_categories",
        "missing_identifiers": "missing_identifiers", "duplicate_identifiers": "duplicate_identifier_rows",
        "invalid_dates": "invalid_dates",
    }
    issues = F.array_compact(F.array(
        *[F.when(F.col(counter) > 0, F.lit(tag)) for tag, counter in tags.items()], F.col("low_variance")
    ))
    return facts.select(
        "column", issues.alias("issues"), F.size(issues).cast("long").alias("issue_count"),
        "missing_values", "missing_percentage", "outliers", "extreme_outliers", "outlier_percentage",
        "rare_categories", "missing_identifiers", "duplicate_identifier_rows", "invalid_dates", "low_variance",
    )


def explode_issues(df: DataFrame, rules: Sequence[tuple[Column, str, Column | str, Column]],
                   name: Column) -> DataFrame:
    """One issue row per rule that fires: ``(condition, type, severity, message)``."""
    structs = [
        F.when(condition, F.struct(
            F.lit(kind).alias("type"), name.alias("column"),
            (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
            message.alias("message"),
        ))
        for condition, kind, severity, message in rules
    ]
    return df.select(F.inline(F.array_compact(F.array(*structs))))


def anomaly_issues(summary: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Explainable issues from a column summary and a duplicate summary (eleven kinds)."""
    c = F.col
    say = lambda form, *cols: F.format_string(form, *cols)
    whole_table = explode_issues(duplicates, [
        (c("duplicate_rows") > 0, "duplicate_rows", "medium",
         say("%d fully duplicated row(s)", c("duplicate_rows"))),
    ], F.lit(None).cast("string"))
    per_column = explode_issues(summary, [
        (c("missing_percentage") >= 50, "high_missingness", "high",
         say("%s: %.2f%% missing", c("column"), c("missing_percentage"))),
        ((c("missing_percentage") >= 20) & (c("missing_percentage") < 50), "moderate_missingness", "medium",
         say("%s: %.2f%% missing", c("column"), c("missing_percentage"))),
        (c("extreme_outliers") > 0, "extreme_numeric_outliers", "high",
         say("%s: %d extreme outlier(s)", c("column"), c("extreme_outliers"))),
        ((c("extreme_outliers") == 0) & (c("outliers") > 0), "numeric_outliers", "medium",
         say("%s: %d outlier(s)", c("column"), c("outliers"))),
        (c("rare_categories") > 0, "rare_categories", "low",
         say("%s: %d rare value(s)", c("column"), c("rare_categories"))),
        (c("missing_identifiers") > 0, "missing_identifiers", "high",
         say("%s: %d identifier(s) missing", c("column"), c("missing_identifiers"))),
        (c("duplicate_identifier_rows") > 0, "duplicate_identifiers", "medium",
         say("%s: %d row(s) share an identifier", c("column"), c("duplicate_identifier_rows"))),
        (c("invalid_dates") > 0, "invalid_dates", "medium",
         say("%s: %d value(s) do not parse as a date", c("column"), c("invalid_dates"))),
        (c("low_variance") == "constant", "constant_column", "medium",
         say("%s: holds a single value", c("column"))),
        (c("low_variance") == "near_constant", "near_constant_column", "low",
         say("%s: almost always the same value", c("column"))),
    ], c("column"))
    return whole_table.unionByName(per_column)


class AnomalyReport:
    """All anomaly sections of a table. Report-sized sections are settled on first use."""

    def __init__(self, table: Table):
        self.table = table

    @cached_property
    def outliers(self) -> DataFrame:
        return frames.settle(numeric_outliers(self.table))

    @cached_property
    def facts(self) -> DataFrame:
        """The counts most sections are made of."""
        return frames.settle(column_facts(self.table))

    @cached_property
    def outlier_totals(self) -> DataFrame:
        return frames.settle(outlier_totals(self.facts))

    @property
    def identifiers(self) -> DataFrame:
        return self.facts.where("is_identifier").select(
            "column", (F.col("rows") - F.col("missing_identifiers")).alias("values_checked"), "missing_identifiers",
            "duplicate_identifier_values", "duplicate_identifier_rows")

    @cached_property
    def datetimes(self) -> DataFrame:
        return frames.settle(datetime_anomalies(self.table))

    @property
    def missingness(self) -> DataFrame:
        return self.facts.select(
            "column", "rows", "missing_values", "missing_percentage",
            missing_severity(F.col("missing_percentage"), F.col("missing_values")).alias("severity"))

    @cached_property
    def low_variance(self) -> DataFrame:
        return frames.settle(low_variance(self.table))

    @property
    def rare_categories(self) -> DataFrame:
        return rare_categories(self.table)

    @property
    def duplicates(self) -> DataFrame:
        return self.table.duplicate_summary

    @property
    def columns(self) -> DataFrame:
        return column_summary(self.facts)

    @cached_property
    def issues(self) -> DataFrame:
        return anomaly_issues(self.columns, self.duplicates)

    @property
    def suspicious_rows(self) -> DataFrame:
        return suspicious_rows(self.table)

    @cached_property
    def suspicious_counts(self) -> DataFrame:
        """One settled row: suspicious_rows, high_risk_rows."""
        scores = row_evidence(self.table).groupBy(*self.table.row_key).agg(F.sum("score").alias("s"))
        return frames.settle(scores.agg(
            F.count(F.lit(1)).alias("suspicious_rows"), stats.count_if(F.col("s") >= 5).alias("high_risk_rows")
        ))

    @cached_property
    def summary(self) -> DataFrame:
        """One settled row of totals."""
        by_severity = self.issues.agg(
            F.count(F.lit(1)).alias("total_issues"),
            *[stats.count_if(F.col("severity") == s).alias(f"{s}_severity_issues") for s in ("high", "medium", "low")],
        )
        totals, dup, rows = self.outlier_totals.first(), self.duplicates.first(), self.suspicious_counts.first()
        return frames.settle(by_severity.select(
            F.lit(dup["rows"]).cast("long").alias("rows"),
            F.lit(len(self.table.columns)).cast("long").alias("columns"),
            F.lit(totals["outliers"]).cast("long").alias("numeric_outliers"),
            F.lit(totals["extreme_outliers"]).cast("long").alias("extreme_numeric_outliers"),
            F.lit(dup["duplicate_rows"]).cast("long").alias("duplicate_rows"),
            F.lit(rows["suspicious_rows"]).cast("long").alias("suspicious_rows"),
            F.lit(rows["high_risk_rows"]).cast("long").alias("high_risk_rows"),
            "total_issues", "high_severity_issues", "medium_severity_issues", "low_severity_issues",
        ))


def detect_anomalies(df: DataFrame, types: Mapping | Profile | None = None,
                     row_key: Sequence[str] = ()) -> AnomalyReport:
    if df.isEmpty():
        raise ValueError("cannot look for anomalies in an empty table")
    return AnomalyReport(Table(df, types, row_key))
