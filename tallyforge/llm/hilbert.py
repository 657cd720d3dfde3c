"""Sharding along a Hilbert curve over several metadata dimensions.

Dimensions are quantised to a few bits, each document gets its index on the curve, documents are
sorted by that index (range partitions, never one task), and the order is cut into runs of equal
count: the `rows` law. Neighbours on the curve are near in every dimension, so a shard's ranges are
narrow in all of them and files can be passed over by any. Only numbers are shuffled, not texts.

Defined cases: a null text has size 1 and checksum 0 as an empty one; a very long text counts whole;
null metadata fall in cell 0; equal texts with equal metadata stay adjacent; ties go by checksum, then
doc_id; repeated rows each give a row; an empty table gives an empty result; extra columns are ignored
unless asked for, and in written shards a column named like one of theirs gets the prefix doc__.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import shared_dir, stash

SHARDS, BITS = 16, 4
ROWS_PER_TASK = 1_000_000


def hilbert_place(cell: tuple[int, ...], bits: int = BITS) -> int:
    """The place of a cell on the Hilbert curve, by Skilling's transposition."""
    x, n = list(cell), len(cell)
    for k in range(bits - 1, 0, -1):
        low = (1 << k) - 1
        for i in range(n):
            if x[i] >> k & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = 0
    for k in range(bits - 1, 0, -1):
        if x[n - 1] >> k & 1:
            turn ^= (1 << k) - 1
    x = [v ^ turn for v in x]
    place = 0
    for k in range(bits - 1, -1, -1):
        for v in x:
            place = place * 2 + (v >> k & 1)
    return place


def curve(spark: SparkSession, n_dims: int, bits: int = BITS) -> DataFrame:
    """Every cell with its place: 2 ** (bits * n_dims) rows, whatever the data."""
    cells = product(range(1 << bits), repeat=n_dims)
    return spark.createDataFrame([(*c, hilbert_place(c, bits)) for c in cells], ", ".join(f"d{i} int" for i in range(n_dims)) + ", curve_index int")


def quantised(column: Column, bits: int = BITS) -> Column:
    """A category's cell, from its checksum."""
    return F.coalesce(F.crc32(column.cast("string")) % (1 << bits), F.lit(0)).cast("int")


def logarithmic(column: Column, bits: int = BITS) -> Column:
    """A size's cell: its binary order of magnitude."""
    return F.least(F.coalesce(F.floor(F.log2(F.greatest(column.cast("double"), F.lit(1.0)))), F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def shards(docs: DataFrame, n_shards: int = SHARDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, size, text_crc32, law, shard, slot, grown_shard and curve_index of every document."""
    where = shared_dir(docs.sparkSession)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size, n_rows = F.octet_length(raw).cast("long") + 1, docs.count()
    cells = docs.select(*keep, size.alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), quantised(F.col("lang")).alias("d0"), quantised(F.col("source")).alias("d1")).withColumn(
        "d2", logarithmic(F.col("size"))
    )
    placed = cells.join(F.broadcast(curve(docs.sparkSession, 3)), ["d0", "d1", "d2"]).drop("d0", "d1", "d2")
    tasks = max(1, -(-n_rows // ROWS_PER_TASK), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["curve_index", "text_crc32", "doc_id"]
    ranged = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order, "size")
    local = F.monotonically_increasing_id()  # task number in the upper 31 bits, row within the task in the lower 33
    rows = stash(ranged.withColumn("at", local), f"{where}/ordered")
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a task
    ranked = rows.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    base, more = n_rows // n_shards, n_rows % n_shards  # the first `more` shards take one more
    edge = (base + 1) * more
    shard = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (base + 1))).otherwise(more + F.floor((F.col("rank") - edge) / max(1, base)))
    start = F.when(F.col("shard") <= more, F.col("shard") * (base + 1)).otherwise(edge + (F.col("shard") - more) * base)
    return ranked.withColumn("shard", shard.cast("long")).select(
        *keep, "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index",
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS) -> None:
    """Writes whole documents by shard, in slot order within each file. Texts are shuffled once, into curve order, so
    that a file holds a run of the curve and thereby a narrow range of every dimension."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")
    placed = shards(docs.select("doc_id", "text", "lang", "source", whole), n_shards, keep=("doc_id", "__doc"))
    own = ("shard", "slot", "curve_index")
    rows = placed.select(*own, *(F.col(f"__doc.`{c}`").alias(f"doc__{c}" if c in own else c) for c in docs.columns))
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
