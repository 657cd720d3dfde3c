"""Exact order statistics of groups of any size, by narrowing ranges of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import written

#: Ranges into which the values between two bounds are counted in a pass; rows up to which a group may meet in one task.
RANGES, SMALL_GROUP = 1024, 1_000_000


def order_statistics(df: DataFrame, by: str, value: str, places: dict[str, Column]) -> DataFrame:
    """by and, for each name, the value at that place (from 0, in terms of n, the group's values) of the group's sorted values. Null values
    and those that are not a number do not count; places beyond a group give null.

    A pass counts the values of each open range by RANGES parts of it, takes the part that holds the place, and goes on between the
    least and the greatest value met there, until they are one. Counts are summed in every task before the shuffle, so a group that
    holds most rows costs a row for each part and task; a part is a monotone function of the value, so no value is misplaced."""
    rows = written(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v")))
    sizes = rows.groupBy("_by").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), c.cast("long").alias("k")) for name, c in places.items())))
    open_ = written(sizes.select("_by", "lo", "hi", "n", asked.alias("a")).where("a.k between 0 and n - 1").select("_by", "a.name", "a.k", "lo", "hi"))
    done = [open_.where("lo = hi").select("_by", "name", F.col("lo").alias("x"))]
    open_ = open_.where("lo <> hi")
    while open_.limit(1).count():
        v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
        share = F.when(hi - lo == float("inf"), (v / 2 - lo / 2) / (hi / 2 - lo / 2)).otherwise((v - lo) / (hi - lo))  # from 0 at lo to 1 at hi
        part = F.least(F.lit(RANGES - 1), F.floor(share * RANGES)).cast("int")
        met = rows.join(F.broadcast(open_) if open_.count() <= 50_000 else open_, "_by").where("_v between lo and hi")
        counts = met.groupBy("_by", "name", "k", part.alias("part")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("_by", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most RANGES rows
        found = written(counts.withColumn("before", before).where("before <= k and k < before + n").select("_by", "name", (F.col("k") - F.col("before")).alias("k"), "lo", "hi"))
        done.append(found.where("lo = hi").select("_by", "name", F.col("lo").alias("x")))
        open_ = found.where("lo <> hi")
    every = done[0]
    for part in done[1:]:
        every = every.union(part)
    named = every.groupBy("_by").agg(*(F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in places))
    return named.withColumnRenamed("_by", by)


def largest_group(df: DataFrame, by: str) -> int:
    return df.groupBy(by).count().agg(F.max("count")).first()[0] or 0


def medians(df: DataFrame, by: str, value: str) -> DataFrame:
    """by and median, the mean of the middle two values. Groups that fit into a task take Spark's own; larger ones are narrowed down."""
    if largest_group(df, by) <= SMALL_GROUP:
        return df.groupBy(by).agg(F.median(value).alias("median"))
    n = F.col("n")
    m = order_statistics(df, by, value, {"_a": F.floor((n - 1) / 2), "_b": F.floor(n / 2)})
    return m.select(by, (F.col("_a") / 2 + F.col("_b") / 2).alias("median"))


def upper_medians(df: DataFrame, by: str, value: str) -> DataFrame:
    """AG-20: by and upper_median, the upper middle of the sorted values: an element that exists, as a double."""
    if largest_group(df, by) <= SMALL_GROUP:
        return df.groupBy(by).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)").cast("double").alias("upper_median"))
    return order_statistics(df, by, value, {"upper_median": F.floor(F.col("n") / 2)})
