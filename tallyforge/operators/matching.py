"""Joins and set operations of record tables: plans, coverage, reuse, validity in time, neighbours, key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def only(df: DataFrame, column: str, selectors: list[str]) -> DataFrame:
    """PRJ-13: rows that a selector names; a selector without a row raises."""
    seen = {r[0] for r in df.where(F.col(column).isin(selectors)).select(column).distinct().collect()}  # at most as many as selectors
    missing = [s for s in selectors if s not in seen]
    if missing:
        raise ValueError(f"selectors match nothing: {', '.join(missing)}")
    return df.where(F.col(column).isin(selectors))


def planned(plan: DataFrame, steps: DataFrame, key: str, condition: str, value: str, sides: tuple[str, str]) -> DataFrame:
    """JN-03: each planned item with the value of its step under both conditions, null where it has none.

    The steps are pivoted in one grouping and joined once."""
    cells = steps.where(F.col(condition).isin(*sides)).groupBy(key).agg(*(F.max(F.when(F.col(condition) == s, F.col(value))).alias(s) for s in sides))
    return plan.join(cells, key, "left")


def label_faults(items: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """JN-05, JN-10: keys whose labels are unknown, duplicate or omitted. One full join of counts."""
    have = items.groupBy(key).agg(F.count("*").alias("items"))
    want = labels.groupBy(key).agg(F.count("*").alias("labels"))
    fault = F.when(F.col("items").isNull(), "unknown").when(F.col("labels").isNull(), "omitted").when(F.col("labels") > 1, "duplicate")
    return have.join(want, key, "full").select(key, fault.alias("fault")).where("fault is not null")


def in_force(df: DataFrame, day: str, start: str = "in_force_from", end: str = "in_force_until") -> DataFrame:
    """JN-11: rows in force on a day: from the start, and before the end if there is one."""
    d = F.lit(day).cast("date")
    return df.where((F.col(start) <= d) & (F.col(end).isNull() | (d < F.col(end))))


def as_of(events: DataFrame, versions: DataFrame, key: str, at: str, start: str) -> DataFrame:
    """JN-11 over many days: each event with the latest version of its key that started by then, null if none had.

    Events and versions are merged in one window by key instead of joined pair by pair."""
    payload = [c for c in versions.columns if c not in (key, start)]
    left = events.select(F.struct("*").alias("_event"), F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(versions.select(F.struct(start, *payload).alias("v")).schema["v"].dataType).alias("_version"))
    right = versions.select(F.lit(None).cast(left.schema["_event"].dataType).alias("_event"), F.col(key).alias("_key"), F.col(start).alias("_at"), F.lit(0).alias("_side"), F.struct(start, *payload).alias("_version"))
    w = Window.partitionBy("_key").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = left.unionByName(right).withColumn("_version", F.last("_version", ignorenulls=True).over(w))
    return seen.where("_side = 1").select("_event.*", F.col(f"_version.{start}").alias(start), *(F.col(f"_version.{c}").alias(c) for c in payload))


def neighbours(nodes: DataFrame, edges: DataFrame, name: str, attributes: list[str]) -> DataFrame:
    """JN-13: each edge of a name with the far node's attributes."""
    far = nodes.select(F.col("id").alias("dst"), *attributes)
    return edges.where(F.col("name") == name).select("src", "dst").distinct().join(far, "dst")


def reuse(wanted: DataFrame, saved: DataFrame, key: str, components: list[str]) -> DataFrame:
    """JN-15, AG-46: whether a saved run serves, and else the components that differ (first one too). Nulls equal nulls."""
    s = saved.select(key, F.lit(True).alias("_saved"), *(F.col(c).alias(f"_{c}") for c in components))
    unlike = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in components)))
    j = wanted.join(s, key, "left").withColumn("unlike", F.when(F.col("_saved"), unlike))
    return j.select(key, F.coalesce(F.size("unlike") == 0, F.lit(False)).alias("reused"), F.get("unlike", F.lit(0)).alias("first_mismatch"), F.array_join("unlike", ",").alias("mismatches"))


def set_report(left: Column, right: Column) -> dict[str, Column]:
    """ST-01 to ST-04: sorted union, difference, equality and containment of two arrays; an absent left side is no subset."""
    return {
        "united": F.array_join(F.array_sort(F.array_union(left, right)), ","), "missing": F.array_join(F.array_sort(F.array_except(left, right)), ","),
        "equal": (F.size(F.array_except(left, right)) == 0) & (F.size(F.array_except(right, left)) == 0),
        "subset": F.coalesce(F.size(F.array_except(left, right)) == 0, F.lit(False)),
    }


def side_by_side(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """ST-05: both sides' values over the union of their keys, 0 where one has none."""
    a, b = left.select(key, F.col(value).alias("left")), right.select(key, F.col(value).alias("right"))
    return a.join(b, key, "full").select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("left", "right")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """ST-06."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def numbered(new: DataFrame, highest: int, order: str, bucket: Column) -> DataFrame:
    """WN-14: seq, the numbers after the highest in use, in the order given. `bucket` never falls as `order` rises and keeps groups small:
    ranks are taken within buckets and shifted by the rows of the buckets before."""
    rows = new.withColumn("_bucket", bucket)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))  # one row a bucket
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(order))
    return rows.withColumn("_rank", rank).join(before, "_bucket").withColumn("seq", F.col("_before") + F.col("_rank") + highest).drop("_bucket", "_rank", "_before")


def band_faults(obs: DataFrame) -> DataFrame:
    """AG-24: of each task: revisions, runs, whether every run has the same invariants, and invariants met twice in a run.

    obs: task, rev, run_id, invariant."""
    cells = obs.groupBy("task", "run_id", "invariant").agg(F.count("*").alias("n"), F.min("rev").alias("rev0"), F.max("rev").alias("rev1"))
    runs = cells.groupBy("task", "run_id").agg(F.array_join(F.array_sort(F.collect_set("invariant")), ",").alias("set"), F.count_if(F.col("n") > 1).alias("twice"),
                                               F.min("rev0").alias("rev0"), F.max("rev1").alias("rev1"))
    return runs.groupBy("task").agg(F.count("*").alias("runs"), (F.min("rev0") == F.max("rev1")).alias("one_rev"), (F.min("set") == F.max("set")).alias("same_invariants"), F.sum("twice").alias("twice"))
