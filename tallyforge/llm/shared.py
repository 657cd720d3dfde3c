"""Tables in the folder that driver and executors share, and small helpers for Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ADAPTIVE = "spark.sql.adaptive.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset: a temporary folder on a local master, which is one
    machine, and an error on a cluster, whose machines would not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
    return f"{base.rstrip('/')}/tallyforge-{uuid.uuid4().hex}"


@contextmanager
def planned_once(spark: SparkSession, once: bool = True) -> Iterator[None]:
    """Within it, plans are not adaptive, if `once`. An adaptive plan takes a job, a thread and a new plan for each of its shuffles, and the
    driver keeps all of them for a while; that is too much for sums by task and for few rows."""
    before = spark.conf.get(ADAPTIVE)
    spark.conf.set(ADAPTIVE, "false" if once else before)
    try:
        yield
    finally:
        spark.conf.set(ADAPTIVE, before)


def n_rows(df: DataFrame) -> int:
    """The rows of a table, or of its distinct keys."""
    with planned_once(df.sparkSession):
        return df.count()


def together(df: DataFrame, few: bool) -> DataFrame:
    """df in one task if it has few rows: grouping and joining them then takes no shuffle."""
    return df.coalesce(1) if few else df


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, each query's shuffle files go once the query has ended (their results are in tables by then)."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stash(df: DataFrame, where: str, **options: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back; lineage ends there."""
    spark = df.sparkSession
    with freed_shuffles(spark):
        df.write.options(compression="zstd", **options).mode("overwrite").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def drop_tables(spark: SparkSession, where: str) -> None:
    """Deletes a folder of stashed tables that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables of at most this many rows may be broadcast (about 100 bytes each).
BROADCAST_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    """A stashed table, broadcast if it has few rows."""
    return F.broadcast(df) if n_rows(df) <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow of a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
