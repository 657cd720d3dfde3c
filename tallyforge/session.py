"""Session defaults shared by tests, bench and scripts; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str | None = None, name: str = "tallyforge") -> SparkSession:
    """A local session with the settings the queries assume (UTC, AQE, Arrow)."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    parts = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TALLYFORGE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir. Where that is unset: a temporary folder on a local master, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
    return f"{base.rstrip('/')}/tallyforge-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the checkpoint folder: lineage ends there, and lost executors take nothing with them."""
    where = checkpoint_folder(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
