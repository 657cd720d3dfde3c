"""Sinks: journals, reports and documents, written by the executors; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.heads import head_text


def append_journal(rows: DataFrame, path: str, key: list[str]) -> None:
    """SNK-01: appends the rows as JSON lines whose keys the journal does not hold yet, so that a repeated write adds nothing.

    Of rows with one key the first in JSON order is written."""
    spark = rows.sparkSession
    line = F.to_json(F.struct(*rows.columns))
    new = rows.select(*key, line.alias("value")).groupBy(*key).agg(F.min("value").alias("value"))
    if _exists(spark, path):
        held = spark.read.schema(rows.select(*key).schema).json(path).distinct()
        new = new.join(held, key, "left_anti")
    new.select("value").write.mode("append").text(path)


def write_report(rows: DataFrame, path: str) -> None:
    """SNK-02, SNK-04: JSON lines with keys in column order and maps in key order; refuses to overwrite (SNK-04)."""
    ordered = [F.map_from_entries(F.array_sort(F.map_entries(c))).alias(c) if t.startswith("map<") else F.col(c) for c, t in rows.dtypes]
    rows.select(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def markdown_table(rows: DataFrame) -> DataFrame:
    """SNK-05: each row as a line of a Markdown table, under the column `line`; bars inside values are escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in rows.columns)), F.lit(" |")).alias("line"))


def document(attributes: dict[str, Column], lists: dict[str, Column], body: Column) -> Column:
    """SNK-07: a Markdown text with a head of attributes and lists; null ones are left out."""
    lines = [F.concat(F.lit(f"{k}: "), c.cast("string")) for k, c in attributes.items()]
    lines += [F.when(F.size(c) > 0, F.concat(F.lit(f"{k}:\n  - "), F.array_join(c, "\n  - "))) for k, c in lists.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), body)


def nested_document(head: Column, body: Column) -> Column:
    """SNK-07: a Markdown text whose head is a map of any depth, given as JSON; readers.heads gives the same JSON back."""
    return F.concat(F.lit("---\n"), head_text(head), F.lit("---\n"), body)


def write_documents(rows: DataFrame, path: str, kind: str, text: Column) -> None:
    """SNK-06, SNK-07: one folder for each kind; each row is one record. Refuses to overwrite."""
    rows.select(F.col(kind), text.alias("value")).write.mode("errorifexists").partitionBy(kind).option("lineSep", "\n").text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
