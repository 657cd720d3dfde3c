"""Cards of trials and assessments and manifests of their items (SRC-19): read with explicit schemas, defaults filled in, and the first thing
that is wrong with each named instead of the card dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Versions, sets, stages and their time boxes, kinds of rules with least points and most time, kinds of reuse, and defaults.
VERSION, SETS = 1, ["D", "R", "H"]
BUDGETS = {"A": 600, "B": 1800, "C": 5400}
RULES = {"speed": (-2.0, 0.90), "quality": (3.0, 1.05), "output-fix": (0.0, 0.0)}
REUSES = ["none", "saved_runs", "calibration", "trial"]
BLOCK_SIZE, MIN_PER_CATEGORY, MIN_EVALUABLE = 4, 4, 8

CONDITION = "struct<id: string, config: string, cmoa: string, config_sha256: string, switch: struct<command: string, ready_url: string, timeout_seconds: int>>"
CARD = (
    "schema_version int, id string, hypothesis string, change string, stage string, suite string, manifests array<string>, take map<string, int>, max_items int, "
    "planning struct<item_seconds: double, overhead_seconds: double, switch_seconds_estimate: double, accept_cut: boolean>, labels array<string>, "
    f"base {CONDITION}, candidate {CONDITION}, reuse struct<kind: string, source: string>, seed int, judge_seed int, metrics array<string>, "
    "rules struct<kind: string, min_delta_q_points: double, max_time_ratio: double, targets array<string>>, budget_seconds int, alternating_blocks boolean, "
    "block_size int, min_items_per_category int, min_evaluable_items int"
).replace("targets array", "targets: array")
MANIFEST = "schema_version int, set string, items array<struct<id: string, order: int, strata: map<string, string>, reason: string>>, weights map<string, double>"
ARTIFACT = "struct<path: string, sha256: string>"
ASSESSMENT = f"schema_version int, id string, finalist struct<report: {ARTIFACT}, resume: {ARTIFACT}, results: {ARTIFACT}>, dataset {ARTIFACT}, labels {ARTIFACT}, holdout_sha256 string"


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file and doc (null for what is no JSON of the schema) of every file under a path."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = F.from_json("value", schema + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return text.select("file", parsed.alias("doc")).withColumn("doc", F.when(F.col("doc._broken").isNull(), F.col("doc")))


def first_fault(*cases: tuple[Column, str]) -> Column:
    """The name of the first case that holds; a case that is null does not."""
    return F.coalesce(*(F.when(F.coalesce(when, F.lit(False)), name) for when, name in cases))


def empty(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def trial_cards(spark: SparkSession, path: str) -> DataFrame:
    """file, fault and the card's fields, with defaults for the budget, block size, floors, reuse and thresholds."""
    c = documents(spark, path, CARD).select("file", F.col("doc").isNull().alias("broken"), "doc.*").drop("_broken")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    by = lambda table, key, i=None: F.element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v if i is None else v[i]))), F.col(key))
    kind = F.coalesce(F.nullif(F.col("reuse.kind"), F.lit("")), F.lit("none"))
    planned = [f"planning.{x}" for x in ("item_seconds", "overhead_seconds", "switch_seconds_estimate")]
    switch = lambda side: (F.col(f"{side}.switch").isNotNull() & empty(f"{side}.switch.command")) | (zero(f"{side}.switch.timeout_seconds") < 0)
    fault = first_fault(
        (F.col("broken"), "not-json"), (~F.col("schema_version").eqNullSafe(VERSION), "version"), (empty("id"), "no-id"), (empty("hypothesis") | empty("change"), "no-hypothesis"),
        (~F.coalesce(F.col("stage").isin([*BUDGETS]), F.lit(False)), "stage"), (empty("suite"), "no-suite"), (F.coalesce(F.size("manifests"), F.lit(0)) <= 0, "no-manifest"),
        (empty("base.id") | empty("candidate.id"), "unnamed-condition"), (F.col("base.id") == F.col("candidate.id"), "one-condition"), (empty("base.config") | empty("candidate.config"), "no-configuration"),
        (~F.coalesce(F.col("rules.kind").isin([*RULES]), F.lit(False)), "rule"), (~kind.isin(REUSES), "reuse"), ((kind != "none") & empty("reuse.source"), "reuse-source"), (zero("budget_seconds") < 0, "budget"),
        (F.exists(F.map_keys("take"), lambda k: ~k.isin(SETS)) | F.exists(F.map_values("take"), lambda n: n < 0), "take"), (zero("max_items") < 0, "max-items"),
        (F.least(*(zero(p) for p in planned)) < 0, "planning"), (switch("base") | switch("candidate"), "switch"),
    )
    filled = lambda name, default: F.when(zero(name) > 0, F.col(name)).otherwise(default)
    return c.withColumns({
        "fault": fault, "reuse": F.struct(kind.alias("kind"), F.col("reuse.source").alias("source")), "budget_seconds": F.when(zero("budget_seconds") == 0, by(BUDGETS, "stage")).otherwise(F.col("budget_seconds")),
        "block_size": filled("block_size", BLOCK_SIZE), "min_items_per_category": filled("min_items_per_category", MIN_PER_CATEGORY), "min_evaluable_items": filled("min_evaluable_items", MIN_EVALUABLE),
        "least_points": F.coalesce("rules.min_delta_q_points", by(RULES, "rules.kind", 0)), "most_time": F.coalesce("rules.max_time_ratio", by(RULES, "rules.kind", 1)),
    }).drop("broken")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """file, fault, set, weights and items (id, place from 1, strata, reason, bucket: the one weighted stratum that the item is in, or '')."""
    m = documents(spark, path, MANIFEST).select("file", F.col("doc").isNull().alias("broken"), "doc.*").drop("_broken")
    weights = F.coalesce("weights", F.create_map().cast("map<string, double>"))
    weighted = lambda i: F.filter(F.map_values(F.coalesce(i["strata"], F.create_map().cast("map<string, string>"))), lambda s: F.map_contains_key(weights, s))
    order = lambda i: F.coalesce(i["order"], F.lit(0))
    numbered = order(F.get("items", F.lit(0))) != 0
    places = F.filter(F.transform("items", lambda i, k: F.struct(order(i).alias("o"), (k + 1).alias("k"))), lambda x: F.when(numbered, x["o"] != x["k"]).otherwise(x["o"] != 0))
    ids = F.transform("items", lambda i: F.coalesce(i["id"], F.lit("")))
    fault = first_fault(
        (F.col("broken"), "not-json"), (~F.col("schema_version").eqNullSafe(VERSION), "version"), (~F.coalesce(F.col("set").isin(SETS), F.lit(False)), "set"), (F.coalesce(F.size("items"), F.lit(0)) <= 0, "no-items"),
        (F.array_contains(ids, ""), "no-id"), (F.size(F.array_distinct(ids)) < F.size(ids), "repeated-id"), (F.size(places) > 0, "order"), (F.exists(F.map_values(weights), lambda w: w < 0), "weight"),
        (F.exists("items", lambda i: F.size(weighted(i)) > 1), "two-buckets"),
    )
    items = F.transform("items", lambda i, k: F.struct(
        i["id"].alias("id"), (k + 1).alias("place"), i["strata"].alias("strata"), i["reason"].alias("reason"), F.coalesce(F.get(weighted(i), F.lit(0)), F.lit("")).alias("bucket"),
    ))
    return m.select("file", fault.alias("fault"), "set", weights.alias("weights"), items.alias("items"))


def assessment_pins(spark: SparkSession, path: str) -> DataFrame:
    """file, id, what (the artifact), path and sha256 of everything that assessment cards pin, and the file's digest now and whether it is the
    pinned one. Relative paths start at the card's folder; a file that is not there has no digest."""
    a = documents(spark, path, ASSESSMENT).where("doc is not null").select("file", "doc.*")
    pins = F.array(*(F.struct(F.lit(what).alias("what"), F.col(c)["path"].alias("path"), F.col(c)["sha256"].alias("sha256")) for what, c in (
        ("report", "finalist.report"), ("resume", "finalist.resume"), ("results", "finalist.results"), ("dataset", "dataset"), ("labels", "labels"))))
    folder = F.regexp_replace("file", "[^/]*$", "")
    at = F.when(F.col("p.path").startswith("/"), F.concat(F.lit("file://"), F.col("p.path"))).otherwise(F.concat(folder, F.col("p.path")))
    rows = a.select("file", "id", F.explode(pins).alias("p"), folder.alias("folder")).select("file", "id", "p.*", at.alias("at"))
    named = [r.at for r in rows.where("path is not null").select("at").distinct().collect()]  # a few for each card
    there = [n for n in named if exists(spark, n)]
    held = spark.createDataFrame([], "at string, now string")
    if there:
        held = spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", "^file:/+", "file:///").alias("at"), F.sha2("content", 256).alias("now"))
    same = F.coalesce(F.col("now") == F.col("sha256"), F.lit(False))
    return rows.withColumn("at", F.regexp_replace("at", "^file:/+", "file:///")).join(held, "at", "left").select("file", "id", "what", "path", "sha256", "now", same.alias("pinned"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
