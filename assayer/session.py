"""Session settings the library is written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session_builder(app: str = "assayer") -> SparkSession.Builder:
    """Settings that matter on any cluster; sizes are left to the deployment.

    UTC keeps timestamps comparable, adaptive execution coalesces and splits
    shuffle partitions, and wide per-column aggregates stay in generated code.
    """
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.codegen.maxFields", "400")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture costs a round trip per expression; wide reports build thousands.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )


def local_session(app: str = "assayer", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    cpus = cpus or min(8, os.cpu_count() or 8)
    spark = (
        session_builder(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Where intermediates go: ``spark.checkpoint.dir``. Only a session on one machine may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="assayer-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
