"""A prepared dataset on storage: sections as Parquet tables, and versions that name one table for each section.

Tables are written first, each to a folder of its own, and never changed. A version
is a manifest (section, location) that one rename puts in place: until then readers
see the version before, so a write that ends midway loses nothing. A reader that
keeps a :class:`Version` sees the same tables whatever is written meanwhile.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.operators import frames

# Sections a bundle may hold.
SECTIONS = (
    "cleaned", "info", "schema_before", "schema_after",
    "quality_before", "quality_after", "quality_components_before", "quality_components_after",
    "quality_columns_before", "quality_columns_after", "quality_issues_before", "quality_issues_after",
    "anomaly_columns_before", "anomaly_columns_after", "anomaly_issues_before", "anomaly_issues_after",
    "suspicious_rows_before", "suspicious_rows_after",
    "cleaning_log", "cleaning_summary",
    "eda_overview", "eda_numeric", "eda_categorical", "eda_top_categories", "eda_correlations", "eda_effects",
    "eda_associations", "eda_datetimes", "eda_trends", "eda_relationships", "eda_flags", "eda_recommendations",
    "chart_specs", "findings",
)
CHART_SECTION = re.compile(r"chart_\d+")
MANIFEST = "section string, location string"


class ConcurrentWrite(RuntimeError):
    """Another version was committed since this write began; nothing was changed."""


def _checked(section: str) -> str:
    if section not in SECTIONS and not CHART_SECTION.fullmatch(section):
        raise ValueError(f"unknown section: {section}")
    return section


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    system, target = _files(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(target)) if system.exists(target) else []


@dataclass(frozen=True)
class Version:
    """One committed state of a bundle; number 0 is an empty one."""

    spark: SparkSession
    path: str
    number: int
    locations: Mapping[str, str]

    def section(self, name: str) -> DataFrame:
        if _checked(name) not in self.locations:
            raise KeyError(f"{self.path} has no section {name}")
        return self.spark.read.parquet(f"{self.path}/{self.locations[name]}")


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n) for n in _names(spark, f"{path.rstrip('/')}/versions")]


def open_bundle(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version, the last unless ``number`` names one."""
    path = path.rstrip("/")
    known = versions(spark, path)
    number = (known[-1] if known else 0) if number is None else number
    if not number:
        return Version(spark, path, 0, {})
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/versions/{number:09d}").collect()  # one row per section
    return Version(spark, path, number, {r["section"]: r["location"] for r in rows})


def _commit(before: Version, locations: Mapping[str, str]) -> Version:
    spark, path, number = before.spark, before.path, before.number + 1
    work = uuid.uuid4().hex
    frames.local_rows(spark, list(locations.items()), MANIFEST).coalesce(1).write.parquet(f"{path}/work/{work}")
    system, source = _files(spark, f"{path}/work/{work}")
    _, target = _files(spark, f"{path}/versions/{number:09d}")
    system.mkdirs(target.getParent())
    # A rename onto a folder that is there moves into it on some file systems, so that is looked for too.
    moved = not system.exists(target) and system.rename(source, target)
    _, inside = _files(spark, f"{path}/versions/{number:09d}/{work}")
    if not moved or system.exists(inside):
        system.delete(inside if moved else source, True)
        raise ConcurrentWrite(f"version {number} of {path} is already there")
    return Version(spark, path, number, dict(locations))


def _write_tables(path: str, sections: Mapping[str, DataFrame]) -> dict[str, str]:
    locations = {}
    for name, df in sections.items():
        locations[_checked(name)] = f"tables/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{locations[name]}")
    return locations


def write_bundle(path: str, sections: Mapping[str, DataFrame]) -> Version | None:
    """A new version that has exactly these sections."""
    if not sections:
        return None
    for name in sections:
        _checked(name)
    before = open_bundle(next(iter(sections.values())).sparkSession, path)
    return _commit(before, _write_tables(before.path, sections))


def read_section(spark: SparkSession, path: str, section: str) -> DataFrame:
    return open_bundle(spark, path).section(section)


def replace_section(path: str, section: str, df: DataFrame) -> Version:
    """A new version in which one section is ``df``, which may be derived from the section itself."""
    before = open_bundle(df.sparkSession, path)
    return _commit(before, {**before.locations, **_write_tables(before.path, {section: df})})


def prune(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove versions but the last ``keep``, and tables and unfinished writes that none of them names. Returns how many tables went."""
    path = path.rstrip("/")
    known = versions(spark, path)
    if not known:
        return 0
    kept = known[-max(1, keep):]
    used = {location.rpartition("/")[2] for n in kept for location in open_bundle(spark, path, n).locations.values()}
    gone = [n for n in _names(spark, f"{path}/tables") if n not in used]
    for folder in [f"versions/{n:09d}" for n in known if n not in kept] + [f"tables/{n}" for n in gone] + ["work"]:
        system, target = _files(spark, f"{path}/{folder}")
        system.delete(target, True)
    return len(gone)


def bundle_info(spark: SparkSession, path: str) -> DataFrame:
    """One row: name, size, scores before and after, and the improvement."""
    return read_section(spark, path, "info").withColumn(
        "quality_improvement", F.round(F.col("score_after") - F.col("score_before"), 2))
