"""Data quality: five scored components, column scores, issues and an overall rating."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions import stats, text, tokens as t
from assayer.operators import anomalies, frames
from assayer.operators.anomalies import AnomalyReport, Table
from assayer.operators.profile import Profile

SEVERITY_ORDER = ("high", "medium", "low")


def conformity(table: Table, counts: DataFrame | None = None) -> DataFrame:
    """Missing, invalid and padded cells per column: one pass, unless they are counted already."""
    kinds = F.create_map(*[F.lit(x) for c in table.columns for x in (c, table.types.get(c) or "")])
    if counts is None:
        counts = frames.aggregate_columns(table.df, {c: anomalies.plain_counts(table, c) for c in table.columns})
    return counts.select(
        "column", F.nullif(kinds[F.col("column")], F.lit("")).alias("semantic_type"), "rows", "missing_values",
        (F.col("rows") - F.col("missing_values")).alias("checked_values"), "invalid_values", "padded",
    )


def completeness(table: Table | DataFrame, row_key: Sequence[str] = (), facts: DataFrame | None = None) -> DataFrame:
    """Per column: missing-like cells and a 0..100 score."""
    facts = anomalies.missingness(Table.of(table, None, row_key)) if facts is None else facts
    share = stats.percent(F.col("missing_values"), F.col("rows"))
    return facts.select(
        "column", "rows", "missing_values", F.round(share, 2).alias("missing_percentage"),
        stats.score(100 - share).alias("score"))


def completeness_total(columns: DataFrame) -> DataFrame:
    cells = F.coalesce(F.sum("rows"), F.lit(0))
    missing = F.coalesce(F.sum("missing_values"), F.lit(0))
    return columns.agg(missing.alias("missing_cells"), cells.alias("total_cells")).select(
        "missing_cells", "total_cells",
        F.round(stats.percent(F.col("missing_cells"), F.col("total_cells")), 2).alias("missing_percentage"),
        F.when(F.col("total_cells") == 0, 0.0).otherwise(
            stats.score(100 - stats.percent(F.col("missing_cells"), F.col("total_cells")))
        ).alias("score"),
    )


def identifier_uniqueness(identifiers: DataFrame) -> DataFrame:
    """Per Identifier column: share of rows whose identifier is shared."""
    rate = stats.percent(F.col("duplicate_identifier_rows"), F.col("values_checked"))
    return identifiers.select(
        "column", "values_checked", "duplicate_identifier_rows",
        F.round(rate, 2).alias("duplicate_percentage"), stats.score(100 - rate).alias("score"),
    )


def uniqueness_total(duplicates: DataFrame, identifiers: DataFrame, rounded: bool = True) -> DataFrame:
    """Row uniqueness, mixed 60:40 with identifier uniqueness when there are identifiers.

    ``rounded``: start from the reported (two-digit) duplicate percentage, as
    when an anomaly report is at hand.
    """
    rate = stats.percent(F.col("duplicate_identifier_rows"), F.col("values_checked"))
    rates = [r[0] for r in identifiers.select(rate).collect() if r[0] is not None]  # one per column
    penalty = sum(rates) / len(rates) if rates else None
    share = F.col("duplicate_percentage") if rounded else stats.percent(F.col("duplicate_rows"), F.col("rows"))
    mixed = 100 - share if penalty is None else 0.6 * (100 - share) + 0.4 * F.lit(100 - penalty)
    return duplicates.select(
        "duplicate_rows", "duplicate_percentage",
        F.round(F.lit(penalty or 0.0), 2).alias("identifier_penalty_percentage"),
        stats.score(mixed).alias("score"),
    )


def validity(table: Table | DataFrame, types: Mapping | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Per column: present values that conform to the semantic type."""
    facts = conformity(Table.of(table, types)) if facts is None else facts
    share = stats.percent(F.col("checked_values") - F.col("invalid_values"), F.col("checked_values"))
    return facts.select(
        "column", "semantic_type", "checked_values", "invalid_values",
        F.when(F.col("checked_values") == 0, 100.0).otherwise(stats.score(share)).alias("validity_score"),
    )


def consistency(table: Table | DataFrame, types: Mapping | None = None, facts: DataFrame | None = None,
                counts: DataFrame | None = None) -> DataFrame:
    """Per column: values written in more than one way, or text with outer whitespace.

    Categories are compared trimmed and lower-cased. Both groupings combine
    map-side and shuffle distinct values only.
    """
    table = Table.of(table, types)
    facts = conformity(table) if facts is None else facts
    categories = table.kinds("Categorical", "Boolean")
    counts = anomalies.category_counts(table, categories) if counts is None else counts.where(F.col("column").isin(categories))
    spellings = (
        counts.groupBy("column", text.folded(F.col("value")).alias("folded"))
        .agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n"))
        .where(F.col("spellings") > 1)
        .groupBy("column").agg(F.sum("n").alias("mixed"))
    )
    checked, bad = F.col("checked_values"), F.col("inconsistent_values")
    return (
        facts.join(F.broadcast(spellings), "column", "left")  # one row per column
        .where(checked > 0)
        .select("column", "checked_values", (F.col("padded") + F.coalesce("mixed", F.lit(0))).alias("inconsistent_values"))
        .withColumn("consistency_score", stats.score(stats.percent(checked - bad, checked)))
    )


def conforming_total(columns: DataFrame, bad: str) -> DataFrame:
    """Total over a validity or consistency table; 100 when nothing was checked."""
    return columns.agg(
        F.coalesce(F.sum("checked_values"), F.lit(0)).alias("checked_values"),
        F.coalesce(F.sum(bad), F.lit(0)).alias(bad),
    ).withColumn("score", F.when(F.col("checked_values") == 0, 100.0).otherwise(
        stats.score(stats.percent(F.col("checked_values") - F.col(bad), F.col("checked_values")))
    ))


def anomaly_quality(report: AnomalyReport) -> DataFrame:
    """One row: the four capped penalties and the anomaly component score."""
    c = F.col
    suspicious, rows = report.suspicious_counts.first(), report.duplicates.first()["rows"]
    facts = report.outlier_totals.withColumns({
        "rows": F.lit(rows).cast("long"),
        "suspicious_rows": F.lit(suspicious["suspicious_rows"]).cast("long"),
        "high_risk_rows": F.lit(suspicious["high_risk_rows"]).cast("long"),
    }).withColumns({
        "suspicious_row_percentage": stats.percent(c("suspicious_rows"), c("rows")),
        "high_risk_row_percentage": stats.percent(c("high_risk_rows"), c("rows")),
        "outlier_penalty": F.least(F.lit(30.0), c("outlier_percentage") * 0.60),
        "extreme_penalty": F.least(F.lit(25.0), stats.percent(c("extreme_outliers"), c("values_checked")) * 1.5),
    }).withColumns({
        "suspicious_penalty": F.least(F.lit(20.0), c("suspicious_row_percentage") * 0.30),
        "high_risk_penalty": F.least(F.lit(25.0), c("high_risk_row_percentage")),
    })
    total = c("outlier_penalty") + c("extreme_penalty") + c("suspicious_penalty") + c("high_risk_penalty")
    shares = ["suspicious_row_percentage", "high_risk_row_percentage", "outlier_penalty", "extreme_penalty",
              "suspicious_penalty", "high_risk_penalty"]
    return facts.select(
        "values_checked", "outliers", "extreme_outliers", "outlier_percentage", "suspicious_rows", "high_risk_rows",
        *[F.round(c(s), 2).alias(s) for s in shares],
        F.round(total, 2).alias("total_penalty"), stats.score(100 - total).alias("score"),
    )


def column_anomaly_score(summary: DataFrame) -> DataFrame:
    penalty = F.least(F.lit(60.0), F.col("outlier_percentage") * 0.75 + F.col("extreme_outliers") * 2.0
                      + F.col("issue_count") * 2.0)
    return summary.select(
        "column", "outliers", "extreme_outliers", "outlier_percentage", "issue_count",
        stats.score(100 - penalty).alias("anomaly_quality_score"),
    )


def overall_score(components: DataFrame) -> DataFrame:
    """Weighted mean over the components present (``component, score`` rows), and its rating."""
    weights = F.create_map(*[F.lit(x) for pair in t.QUALITY_WEIGHTS.items() for x in pair])
    w = F.when(F.col("score").isNotNull(), weights[F.col("component")])
    mean = F.try_divide(F.sum(F.col("score") * w), F.sum(w))
    return components.agg(F.coalesce(stats.score(mean), F.lit(0.0)).alias("overall_score")).withColumn(
        "rating", rating(F.col("overall_score"))
    )


def rating(score: Column) -> Column:
    return (
        F.when(score >= 95, "Excellent").when(score >= 85, "Very Good").when(score >= 75, "Good")
        .when(score >= 60, "Fair").when(score >= 40, "Poor").otherwise("Critical")
    )


def quality_issues(columns: DataFrame, identifiers: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Issues behind the scores (eight kinds) from column quality and uniqueness tables."""
    c = F.col
    say = lambda form, *cols: F.format_string(form, *cols)
    graded = lambda condition: F.when(condition, "high").otherwise("medium")
    whole = anomalies.explode_issues(duplicates, [
        (c("duplicate_rows") > 0, "duplicate_rows", graded(c("duplicate_percentage") >= 10),
         say("%d duplicated row(s), %.2f%%", c("duplicate_rows"), c("duplicate_percentage"))),
    ], F.lit(None).cast("string"))
    ids = anomalies.explode_issues(identifiers, [
        (c("duplicate_identifier_rows") > 0, "duplicate_identifiers", graded(c("duplicate_percentage") >= 10),
         say("%s: %d row(s) share an identifier, %.2f%%", c("column"), c("duplicate_identifier_rows"),
             c("duplicate_percentage"))),
    ], c("column"))
    missing = say("%s: %.2f%% missing", c("column"), c("missing_percentage"))
    per_column = anomalies.explode_issues(columns, [
        (c("missing_percentage") >= 50, "high_missingness", "high", missing),
        ((c("missing_percentage") >= 20) & (c("missing_percentage") < 50), "moderate_missingness", "medium", missing),
        (c("validity_score") < 90, "invalid_values", graded(c("validity_score") < 70),
         say("%s: validity %.2f of 100", c("column"), c("validity_score"))),
        (c("consistency_score") < 90, "inconsistent_values", graded(c("consistency_score") < 70),
         say("%s: consistency %.2f of 100", c("column"), c("consistency_score"))),
        (c("extreme_outliers") > 0, "extreme_outliers", "high",
         say("%s: %d extreme outlier(s)", c("column"), c("extreme_outliers"))),
        ((c("extreme_outliers") == 0) & (c("outlier_percentage") >= 10), "high_outlier_rate",
         graded(c("outlier_percentage") >= 25),
         say("%s: %.2f%% outliers", c("column"), c("outlier_percentage"))),
    ], c("column"))
    return whole.unionByName(ids).unionByName(per_column)


def priority_findings(issues: DataFrame, limit: int = 10) -> DataFrame:
    """The first issues by severity, then column name (table-wide issues first)."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY_ORDER)), F.col("severity"))
    return issues.orderBy(rank, F.coalesce("column", F.lit("")), "type").limit(limit)


class QualityReport:
    """All quality sections of a table; every section is report-sized and settled on first use.

    Without an anomaly report the anomaly component is 100 and outliers are not
    considered, which reproduces a score taken before anomalies are known.
    """

    def __init__(self, table: Table, anomaly_report: AnomalyReport | None = None):
        self.table, self.anomaly_report = table, anomaly_report

    @cached_property
    def facts(self) -> DataFrame:
        return frames.settle(conformity(self.table, self.table.cell_counts if self.anomaly_report else None))

    @property
    def completeness(self) -> DataFrame:
        return completeness(self.table, facts=self.facts)

    @cached_property
    def identifiers(self) -> DataFrame:
        found = (self.anomaly_report.identifiers if self.anomaly_report
                 else frames.settle(anomalies.identifier_anomalies(self.table)))
        return identifier_uniqueness(found)

    @cached_property
    def uniqueness(self) -> DataFrame:
        return frames.settle(uniqueness_total(
            self.table.duplicate_summary, self.identifiers, rounded=self.anomaly_report is not None
        ))

    @property
    def validity(self) -> DataFrame:
        return validity(self.table, facts=self.facts)

    @cached_property
    def consistency(self) -> DataFrame:
        return frames.settle(consistency(self.table, facts=self.facts, counts=self.table.frequencies))

    @cached_property
    def anomaly_quality(self) -> DataFrame | None:
        return frames.settle(anomaly_quality(self.anomaly_report)) if self.anomaly_report else None

    @cached_property
    def components(self) -> DataFrame:
        """``component, score, weight, explanation``, one row per component."""
        weights = F.create_map(*[F.lit(x) for pair in t.QUALITY_WEIGHTS.items() for x in pair])
        say = lambda form, *cols: F.format_string(form, *map(F.col, cols))
        parts = [
            ("completeness", completeness_total(self.completeness),
             F.when(F.col("missing_percentage") == 0, "no missing cells")
             .otherwise(say("%.2f%% of all cells are missing", "missing_percentage"))),
            ("uniqueness", self.uniqueness,
             F.when((F.col("duplicate_rows") == 0) & (F.col("identifier_penalty_percentage") == 0),
                    "no duplicate rows or identifiers")
             .otherwise(say("%d duplicate row(s); on average %.2f%% of identifiers are shared",
                            "duplicate_rows", "identifier_penalty_percentage"))),
            ("validity", conforming_total(self.validity, "invalid_values"),
             F.when(F.col("invalid_values") == 0, "every value fits its type")
             .otherwise(say("%d value(s) do not fit their type", "invalid_values"))),
            ("consistency", conforming_total(self.consistency, "inconsistent_values"),
             F.when(F.col("inconsistent_values") == 0, "no mixed spellings")
             .otherwise(say("%d value(s) are written in more than one way", "inconsistent_values"))),
        ]
        if self.anomaly_quality is not None:
            parts.append(("anomaly_quality", self.anomaly_quality,
                          F.when(F.col("outliers") + F.col("extreme_outliers") + F.col("suspicious_rows") == 0,
                                 "no anomalies")
                          .otherwise(say("%d outlier(s), %d of them extreme, and %d suspicious row(s)",
                                         "outliers", "extreme_outliers", "suspicious_rows"))))
        else:
            nothing = self.table.df.sparkSession.range(1).select(F.lit(100.0).alias("score"))
            parts.append(("anomaly_quality", nothing, F.lit("no anomalies")))
        return frames.settle(frames.union_all([
            part.select(F.lit(name).alias("component"), "score", weights[F.lit(name)].alias("weight"),
                        told.alias("explanation"))
            for name, part, told in parts
        ]))

    @cached_property
    def overall(self) -> DataFrame:
        return frames.settle(overall_score(self.components))

    @cached_property
    def columns(self) -> DataFrame:
        """One row per column with every column score."""
        unique = self.table.unique_counts
        uniques = frames.report(self.table.df.sparkSession,
                                [{"column": c, "unique_values": n} for c, n in unique.items()],
                                "column string, unique_values long")
        joined = (
            self.completeness.join(uniques, "column")
            .join(self.validity.select("column", "semantic_type", "validity_score"), "column", "left")
            .join(self.consistency.select("column", "consistency_score"), "column", "left")
        )
        if self.anomaly_report:
            joined = joined.join(column_anomaly_score(self.anomaly_report.columns), "column", "left")
        else:
            joined = joined.select("*", F.lit(0).cast("long").alias("outliers"),
                                   F.lit(0).cast("long").alias("extreme_outliers"),
                                   F.lit(0.0).alias("outlier_percentage"), F.lit(100.0).alias("anomaly_quality_score"))
        present = F.col("rows") - F.col("missing_values")
        return frames.settle(joined.select(
            "column", "semantic_type", "rows", "missing_values", "missing_percentage",
            F.col("score").alias("completeness_score"), "unique_values",
            F.round(stats.ratio(F.col("unique_values"), present), 2).alias("unique_ratio"),
            F.coalesce("validity_score", F.lit(100.0)).alias("validity_score"),
            F.coalesce("consistency_score", F.lit(100.0)).alias("consistency_score"),
            "outliers", "extreme_outliers", "outlier_percentage", "anomaly_quality_score",
        ))

    @cached_property
    def issues(self) -> DataFrame:
        return frames.settle(quality_issues(self.columns, self.identifiers, self.table.duplicate_summary))

    @property
    def priority_findings(self) -> DataFrame:
        return priority_findings(self.issues)

    @cached_property
    def summary(self) -> DataFrame:
        overall = self.overall.first()
        return frames.settle(self.issues.agg(
            F.lit(self.table.rows).cast("long").alias("rows"),
            F.lit(len(self.table.columns)).cast("long").alias("columns"),
            F.lit(overall["overall_score"]).alias("overall_score"),
            F.lit(overall["rating"]).alias("rating"),
            *[stats.count_if(F.col("severity") == s).alias(f"{s}_severity_issues") for s in SEVERITY_ORDER],
            F.count(F.lit(1)).alias("total_issues"),
            F.lit(self.anomaly_report is not None).alias("anomalies_considered"),
        ))


def analyze_quality(df: DataFrame, types: Mapping | Profile | None = None, row_key: Sequence[str] = (),
                    include_anomalies: bool = True) -> QualityReport:
    if df.isEmpty():
        raise ValueError("cannot score an empty table")
    table = Table(df, types, row_key)
    return QualityReport(table, AnomalyReport(table) if include_anomalies else None)
