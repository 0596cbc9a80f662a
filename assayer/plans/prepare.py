"""Prepare a dataset: profile, score, clean, score again, explore, chart, store."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.operators import anomalies, charts, cleaning, eda, findings, frames, profile, quality
from assayer.operators.anomalies import AnomalyReport, Table
from assayer.sources import bundle, readers

ROW_KEY = "row_key"


@dataclass
class Assessment:
    """Schema, anomalies and quality of one state of a table."""

    profile: profile.Profile
    anomalies: AnomalyReport
    quality: quality.QualityReport

    def sections(self, suffix: str) -> dict[str, DataFrame]:
        return {
            f"schema_{suffix}": self.profile.to_df(),
            f"quality_{suffix}": self.quality.summary,
            f"quality_components_{suffix}": self.quality.components,
            f"quality_columns_{suffix}": self.quality.columns,
            f"quality_issues_{suffix}": self.quality.issues,
            f"anomaly_columns_{suffix}": self.anomalies.columns,
            f"anomaly_issues_{suffix}": self.anomalies.issues,
            f"suspicious_rows_{suffix}": self.anomalies.suspicious_rows,
        }


@dataclass
class Prepared:
    name: str
    before: Assessment
    after: Assessment
    cleaned: DataFrame
    cleaning: cleaning.CleanResult
    eda: eda.EdaReport
    charts: list[charts.Chart]
    findings: DataFrame
    sections: dict[str, DataFrame] = field(default_factory=dict)


def assess(df: DataFrame, row_key: Sequence[str], include_anomalies: bool = True) -> Assessment:
    """Profile, then anomalies, then quality, which draws on the anomalies.

    ``include_anomalies=False`` scores quality without them.
    """
    found = profile.schema_profile(df, row_key)
    table = Table(df, found, row_key)
    report = AnomalyReport(table)
    return Assessment(found, report, quality.QualityReport(table, report if include_anomalies else None))


def score_delta(before: quality.QualityReport, after: quality.QualityReport) -> DataFrame:
    """Component and overall scores before and after, and the difference."""
    def scores(report: quality.QualityReport) -> DataFrame:
        return report.components.select("component", "score").unionByName(
            report.overall.select(F.lit("overall").alias("component"), F.col("overall_score").alias("score")))

    return scores(before).withColumnRenamed("score", "before").join(
        scores(after).withColumnRenamed("score", "after"), "component"
    ).withColumn("change", F.round(F.col("after") - F.col("before"), 2))


def keyed(df: DataFrame, row_key: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Stage the input; without a row key of its own it gets one from the staged files."""
    staged = frames.stage(frames.nan_to_null(df))
    return (staged, list(row_key)) if row_key else (readers.with_row_key(staged, ROW_KEY), [ROW_KEY])


def prepare(df: DataFrame, name: str = "dataset", row_key: Sequence[str] = (), path: str | None = None,
            include_anomalies: bool = True) -> Prepared:
    """Run the whole preparation on a table; with ``path``, store the result as a bundle there.

    The input and the cleaned table are staged once each; every step reads from
    there. Reports are at most one row per column or column pair.
    """
    if df.isEmpty():
        raise ValueError("cannot prepare an empty table")
    source, key = keyed(df, row_key)
    before = assess(source, key, include_anomalies)
    cleaned = cleaning.clean(source, before.profile, key)
    table = frames.stage(cleaned.df)
    after = assess(table, key, include_anomalies)
    explored = eda.EdaReport(after.anomalies.table)
    chosen = charts.automatic_charts(after.anomalies.table)
    plain = table.drop(*key) if not row_key else table
    score_before, score_after = (a.quality.overall.first()["overall_score"] for a in (before, after))
    found = findings.statistical_findings(after.anomalies.table, score_after)
    info = frames.local_rows(source.sparkSession, [(name, before.profile.rows, after.profile.rows, len(plain.columns), score_before, score_after)],
        "name string, original_rows long, rows long, columns int, score_before double, score_after double")
    result = Prepared(name, before, after, plain, cleaned, explored, chosen, found)
    result.sections = {
        "info": info, "cleaned": plain, **before.sections("before"), **after.sections("after"),
        "cleaning_log": cleaned.log, "cleaning_summary": cleaned.summary,
        "eda_overview": explored.overview, "eda_numeric": explored.numeric, "eda_categorical": explored.categorical,
        "eda_top_categories": explored.top_categories, "eda_correlations": explored.correlations,
        "eda_effects": explored.effects, "eda_associations": explored.associations,
        "eda_datetimes": explored.datetimes, "eda_trends": explored.trends,
        "eda_relationships": explored.important_relationships, "eda_flags": explored.flags,
        "eda_recommendations": explored.chart_recommendations,
        "chart_specs": charts.spec_table(after.anomalies.table, chosen), "findings": found,
        **{f"chart_{i}": c.data for i, c in enumerate(chosen)},
    }
    if path:
        bundle.write_bundle(path, result.sections)
    return result


def prepare_dataset(spark: SparkSession, file: str, name: str, path: str | None = None) -> Prepared:
    """Load a CSV or Excel file and prepare it."""
    return prepare(readers.load_dataset(spark, file), name, path=path)
