"""Blinded label packets: candidates under letters in an order that a key gives, answers that come back, and what is refused of them;
and claims on holdout items, made once however often a task is tried."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


def letters(place: Column) -> Column:
    """0 to A, 25 to Z, 26 to AA: bijective in base 26, up to four letters."""
    out, left = F.lit(""), place.cast("long") + 1
    for _ in range(4):
        out = F.when(left > 0, F.concat(F.char(65 + (left - 1) % 26), out)).otherwise(out)
        left = F.when(left > 0, F.floor((left - 1) / 26)).otherwise(F.lit(0)).cast("long")
    return out


def digest_of(rows: Column) -> Column:
    """SHA-256 of an array of strings in order, each with its length before it."""
    return F.sha2(F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat(F.octet_length(r).cast("string"), F.lit(":"), r)), ""), 256)


def packet(candidates: DataFrame, annotator: str, key: str) -> DataFrame:
    """item, label, body and what the coordinator keeps: candidate, sha256, and the packet's and the mapping's digest of the item.

    candidates: item, candidate, body. The order of an item's candidates is that of SHA-256 of key, annotator, item and candidate, so it
    can be made again from the key and tells nothing without it. The packet's digest is over labels and bodies, the mapping's over
    labels, candidates and bodies' digests and the annotator. Candidates of one item are few (a person reads them all)."""
    item = F.col("item").cast("string")
    at = F.sha2(F.concat_ws("|", F.lit(key), F.lit(annotator), item, F.col("candidate").cast("string")), 256)
    label = letters(F.row_number().over(Window.partitionBy("item").orderBy(at, "candidate")) - 1)
    rows = candidates.select("item", "candidate", F.coalesce("body", F.lit("")).alias("body")).withColumns({"label": label, "sha256": F.sha2("body", 256)})
    seals = rows.groupBy("item").agg(
        digest_of(F.collect_list(F.concat_ws(" ", "label", "sha256"))).alias("packet_sha256"),
        F.sha2(F.concat_ws("|", F.lit(annotator), digest_of(F.collect_list(F.concat_ws(" ", "label", "sha256", F.col("candidate").cast("string"))))), 256).alias("mapping_sha256"),
    )
    return rows.join(seals, "item").withColumn("annotator", F.lit(annotator))


def import_answers(mapping: DataFrame, answers: DataFrame) -> DataFrame:
    """item, refusal (null if the answer stands), annotator, acceptable (candidates in order), all_bad and rationale of every item that is asked or answered.

    mapping: packet() as it is now made again from its sources, so a changed body changes its digests. answers: item, annotator,
    packet_sha256, mapping_sha256, acceptable (labels), all_bad, rationale. Refusals, the first that holds: unknown-item,
    unanswered, repeated-item, annotator, packet-changed, mapping-changed, no-rationale, unknown-label, repeated-label, choice (all
    bad and something acceptable, or neither)."""
    names = F.map_from_entries(F.collect_list(F.struct("label", F.col("candidate").cast("string").alias("candidate"))))
    asked = mapping.groupBy("item").agg(names.alias("names"), *(F.first(c).alias(f"_{c}") for c in ("annotator", "packet_sha256", "mapping_sha256")))
    once = answers.groupBy("item").agg(F.count("*").alias("_n"), F.min_by(F.struct("annotator", "packet_sha256", "mapping_sha256", "acceptable", "all_bad", "rationale"), F.coalesce("rationale", F.lit(""))).alias("a"))
    j = asked.join(once, "item", "full")
    labels, bad = F.coalesce("a.acceptable", F.array().cast("array<string>")), F.coalesce("a.all_bad", F.lit(False))
    chosen = F.transform(labels, lambda x: F.try_element_at("names", x))
    refusal = (
        F.when(F.col("names").isNull(), "unknown-item").when(F.col("_n").isNull(), "unanswered").when(F.col("_n") > 1, "repeated-item").when(~F.col("a.annotator").eqNullSafe(F.col("_annotator")), "annotator")
        .when(~F.col("a.packet_sha256").eqNullSafe(F.col("_packet_sha256")), "packet-changed").when(~F.col("a.mapping_sha256").eqNullSafe(F.col("_mapping_sha256")), "mapping-changed")
        .when(F.trim(F.coalesce("a.rationale", F.lit(""))) == "", "no-rationale").when(F.exists(chosen, lambda c: c.isNull()), "unknown-label")
        .when(F.size(F.array_distinct(labels)) < F.size(labels), "repeated-label").when(bad == (F.size(labels) > 0), "choice")
    )
    fine = lambda c: F.when(refusal.isNull(), c)
    return j.select("item", refusal.alias("refusal"), fine(F.col("_annotator")).alias("annotator"), fine(F.array_sort(chosen)).alias("acceptable"), fine(bad).alias("all_bad"), fine(F.col("a.rationale")).alias("rationale"))


def claim_keys(items: DataFrame) -> DataFrame:
    """items with key_kind and key of each thing by which a holdout item may be known: its conversation, its source, and its source's cluster."""
    of = lambda kind, *parts: F.struct(F.lit(kind).alias("key_kind"), F.sha2(F.to_json(F.array(F.lit(kind), *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))), 256).alias("key"))
    keys = F.array(of("conversation", "conversation_sha256"), of("source", "source", "source_id"), of("source_cluster", "source", "cluster"))
    return items.select("*", F.explode(keys).alias("k")).select("*", "k.*").drop("k")


def claim(items: DataFrame, registry: str, assessment: str, resume: bool = False) -> DataFrame:
    """key_kind, key and state of every key of the items: `claimed` by this assessment or `refused` because another has it, or because
    this one has it from before and does not resume.

    items: source, source_id, cluster, conversation_sha256. registry: a folder that all executors write to and whose file system makes
    a file only if it is not there. A claim is a file named by its key that holds the assessment and, but for clusters, whose item it is.
    A task that is tried again meets its own file, which says the same, and so gets the same answer; a start of the assessment is told
    from another by a file of its own."""
    spark = items.sparkSession
    where, resource = local_folder(registry), f"{assessment}"
    os.makedirs(where, exist_ok=True)
    started = create(os.path.join(where, f"assessment-{hex_name(resource)}.json"), resource)
    again = not started and not resume
    provenance = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "source_id", "conversation_sha256", "cluster")))
    keys = claim_keys(items).select("key_kind", "key", F.when(F.col("key_kind") == "source_cluster", F.lit("")).otherwise(provenance).alias("whose")).distinct()

    def take(rows):
        for r in rows:
            held = f"{resource}\n{r.whose}"
            path = os.path.join(where, f"{r.key_kind}-{r.key}.json")
            mine = create(path, held) or read(path) == held
            yield Row(key_kind=r.key_kind, key=r.key, state="claimed" if mine and not again else "refused")

    return spark.createDataFrame(keys.rdd.mapPartitions(take), "key_kind string, key string, state string")


def hex_name(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def local_folder(path: str) -> str:
    return path.removeprefix("file://")


def create(path: str, text: str) -> bool:
    """Whether the file was made here: it appears whole or not at all, and only if no other has its name."""
    part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(part, "w", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    try:
        os.link(part, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(part)


def read(path: str) -> str:
    with open(path, encoding="utf-8") as held:
        return held.read()
