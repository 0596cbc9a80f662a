"""Shared storage: staged tables under the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="assayer-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a staged table; it is removed when the Python process ends."""
    path = f"{shared_dir(spark)}/assayer-{uuid.uuid4().hex}/{name}"
    _staged.append((spark, path.rpartition("/")[0]))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def release(staged: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    fs, target = file_system(staged.sparkSession, staged.staged_at)
    fs.delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer in use: it learns of them by garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path and the path as its own type."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, target = file_system(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(target)) if fs.exists(target) else []


@atexit.register
def _release() -> None:
    for spark, path in _staged:
        with contextlib.suppress(Exception):  # the session may have ended before
            fs, target = file_system(spark, path)
            fs.delete(target, True)
