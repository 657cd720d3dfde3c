"""Places and running sums along an order, by sorted range partitions and the totals of the partitions before.

No group, however large, meets in one task: a task holds a range of the order, and what came before it is one row for each
task and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import written

ROWS_PER_TASK = 1_000_000
#: Offsets up to this number are broadcast (about 100 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 50_000


def ranked(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column] | None = None, place: str = "place") -> DataFrame:
    """df with place (from 1) of each row in its group, and the sums of each Column up to and with the row. Equal rows of an order may
    come in any turn; null groups are groups, and null order values come first where the order does not say otherwise."""
    sums, spark = sums or {}, df.sparkSession
    rows = written(df.withColumns({f"_v_{k}": F.coalesce(c.cast("long"), F.lit(0)) for k, c in sums.items()}))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_TASK))
    keys = [*(F.col(b).asc_nulls_first() for b in by), *order]
    dealt = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    at = written(dealt).withColumn("_part", F.shiftright("_at", 33))
    local = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    inside = at.withColumns({"_row": F.row_number().over(local), **{f"_s_{k}": F.sum(f"_v_{k}").over(local) for k in sums}})
    totals = at.groupBy("_part", *by).agg(F.count("*").alias("_rows"), *(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    group = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the group
    before = lambda total, name: F.coalesce(F.sum(total).over(group), F.lit(0)).alias(name)
    offsets = written(totals.select(F.col("_part").alias("_p"), *(F.col(b).alias(f"_g_{b}") for b in by), before("_rows", "_first"), *(before(f"_t_{k}", f"_o_{k}") for k in sums)))
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    same = F.col("_part") == F.col("_p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    joined = inside.join(offsets, same)
    return joined.select(*df.columns, (F.col("_row") + F.col("_first")).alias(place), *((F.col(f"_s_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums))
