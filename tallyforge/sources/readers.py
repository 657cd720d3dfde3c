"""Readers of recorded evaluations: explicit schemas, versions checked, malformed lines set apart or refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.heads import head_json

RUN_ID = r"\d{8}T\d{6}Z-[0-9a-f]{8}"


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """SRC-08, SRC-09: one record a line, blank lines ignored; strict refuses lines that are not JSON of the schema or have unknown keys."""
    names = [f.strip().split()[0] for f in _top_fields(schema)]
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", schema).alias("r"), F.json_object_keys("value").alias("keys"))
    if strict:
        fine = F.col("keys").isNotNull() & (F.size(F.array_except("keys", F.array(*map(F.lit, names)))) == 0)
        rows = rows.where(F.assert_true(fine, F.concat(F.lit("malformed record: "), F.col("value"))).isNull())
    return rows.where("keys is not null").select("r.*")


def _top_fields(schema: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]


def versioned(df: DataFrame, version: int = 1) -> DataFrame:
    """SRC-02: records of another version are passed over."""
    return df.where(F.col("schema_version") == version)


def with_run_id(df: DataFrame, run_id: str = "run_id") -> DataFrame:
    """SRC-03: an empty id is the directory's name; one that is malformed raises."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    named = df.withColumn(run_id, F.coalesce(F.nullif(F.col(run_id), F.lit("")), folder))
    return named.where(F.assert_true(F.col(run_id).rlike(f"^{RUN_ID}$"), F.lit("malformed run id")).isNull())


def trace_runs(spark: SparkSession, roots: list[str], schema: str) -> DataFrame:
    """SRC-01, SRC-07: run.json of every run directory under the roots; the first root that has a run wins."""
    out = None
    for k, root in enumerate(roots):
        read = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "run.json").json(root)
        inside = F.regexp_extract(F.col("_metadata.file_path"), rf"/({RUN_ID})/run\.json$", 1) != ""
        one = with_run_id(versioned(read.where(inside))).withColumn("_root", F.lit(k))
        out = one if out is None else out.union(one)
    rn = F.row_number().over(Window.partitionBy("run_id").orderBy("_root"))
    return out.withColumn("_rn", rn).where("_rn = 1").drop("_rn", "_root")


BAND_ROW = "struct<invariant: string, value: double, ci_half: double, band_lo: double, band_hi: double, verdict: string>"
CANDIDATE = "proposer_id string, model string, status string, error string, finish_reason string, usage struct<prompt_tokens: int, completion_tokens: int>, diff struct<files: array<string>>"
VERIFY = f"candidate_id string, status string, exit_code int, apply_error string, error string, band struct<failed: array<string>, rows: array<{BAND_ROW}>>"
SELECTION = "selection struct<kind: string, candidate_id: string>, also_passed array<string>"
TRACE_RUN = (
    "schema_version int, run_id string, prompt_version string, task struct<id: string, dir: string, files: array<string>>, proposers array<struct<id: string, model: string>>, "
    "config struct<proposers: array<struct<id: string, timeout_seconds: int>>, verify: struct<timeout_seconds: int>>"
)


def _of_runs(spark: SparkSession, root: str, schema: str, below: str) -> DataFrame:
    """Files at `below` (a pattern with groups) in run directories under root, with run_id and the named group `part` of each."""
    read = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    pattern = rf"/({RUN_ID})/{below}$"
    path = F.col("_metadata.file_path")
    part = F.regexp_extract(path, pattern, 2) if "(" in below else F.lit("")
    return read.withColumns({"run_id": F.regexp_extract(path, pattern, 1), "part": part}).where("run_id <> ''")


def candidates(spark: SparkSession, root: str) -> DataFrame:
    """SRC-04: candidates/<id>.json of every run; an empty proposer_id is the file's name."""
    rows = _of_runs(spark, root, CANDIDATE, r"candidates/([^/]+)\.json")
    return rows.select(
        "run_id", F.coalesce(F.nullif("proposer_id", F.lit("")), "part").alias("proposer_id"), "model", "status", "error", "finish_reason",
        F.coalesce("usage.prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("usage.completion_tokens", F.lit(0)).alias("completion_tokens"),
        F.coalesce("diff.files", F.array().cast("array<string>")).alias("diff_files"),
    )


def verifies(spark: SparkSession, root: str) -> DataFrame:
    """SRC-05: verify/<id>/result.json of every run; the directory's name tells the proposer, and an absent candidate_id."""
    rows = _of_runs(spark, root, VERIFY, r"verify/([^/]+)/result\.json")
    return rows.select(
        "run_id", F.col("part").alias("proposer_id"), F.coalesce(F.nullif("candidate_id", F.lit("")), "part").alias("candidate_id"), F.col("status").alias("verify_status"),
        F.coalesce("exit_code", F.lit(0)).alias("exit_code"), "apply_error", "error", F.col("band.failed").alias("band_failed"), F.col("band.rows").alias("band_rows"),
    )


def selections(spark: SparkSession, root: str) -> DataFrame:
    """SRC-06: select.json of every run that has one; selected is null where no candidate was."""
    kind = F.col("selection.kind")
    return _of_runs(spark, root, SELECTION, r"select\.json").select(
        "run_id", kind.alias("kind"), F.when(kind == "selected", F.col("selection.candidate_id")).alias("selected"), F.coalesce("also_passed", F.array().cast("array<string>")).alias("also_passed")
    )


def checked(df: DataFrame, fine: Column, said: str) -> DataFrame:
    """df, which raises with the name of its file where a record is not fine (or the check is null)."""
    return df.where(F.assert_true(F.coalesce(fine, F.lit(False)), F.concat(F.lit(f"{said}: "), F.col("_metadata.file_path"))).isNull())


SUITE = "schema_version int, id string, face string, split string, source string, license string, tasks array<struct<id: string, dir: string, stratum: string, gold: string>>"
GOLD = "gold string, method string, margin_stratum string, bt_top string, hard boolean, models map<string, string>, judgments_used int, human_annotators int"
ORDER = "struct<first: string, second: string, choice: string, choice_candidate: string, status: string, retries: int, latency_ms: bigint>"
JUDGED = (
    f"schema_version int, candidates array<string>, pairs array<struct<pair: array<string>, orders: array<{ORDER}>, verdict: string, draw_reason: string>>, "
    "outcome struct<kind: string, candidate_id: string, reason: string>, consensus struct<agreement: string>, tie_break struct<key: string>, "
    "swap_consistent_pairs int, invalid_output_retries int, latency_ms bigint"
)
BAND = f"struct<judged: int, failed: array<string>, skipped: array<string>, rows: array<{BAND_ROW}>>"
RESULT = f"schema_version int, status string, exit_code int, apply_error string, error string, band {BAND}"
DOCTOR_RUN = f"struct<label: string, kind: string, mutant_index: int, diff: string, expect: string, origin: string, operator: string, note: string, project_name: string, status: string, reused_from: string, band: {BAND}>"
DOCTOR = f"schema_version int, run_id string, task string, rev string, verdict string, runs array<{DOCTOR_RUN}>, started_at string, finished_at string"
# The states of a verification.
STATUSES = ("pass", "fail", "apply_failed", "timeout", "runner_error")


def suite_items(spark: SparkSession, manifest: str) -> DataFrame:
    """SRC-11: a row for each item of a suite's manifest, with its gold file's label; null where the item has none.

    Another version, a suite without id or items, and an item without id or named twice raise. An item's folder is
    its id and its gold file gold.json where the manifest names none; both lie under the manifest's folder."""
    fine = (F.col("schema_version") == 1) & (F.col("id") != "") & (F.size("tasks") > 0) & ~F.exists("tasks", lambda t: F.coalesce(t["id"], F.lit("")) == "")
    once = F.size(F.array_distinct("tasks.id")) == F.size("tasks")
    suite = checked(spark.read.schema(SUITE).option("multiLine", True).json(manifest), fine & once, "malformed suite")
    folder = F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", "")
    items = suite.select(F.col("id").alias("suite"), "split", folder.alias("folder"), F.posexplode("tasks").alias("place", "t"))
    given = lambda f, other: F.coalesce(F.nullif(F.col(f"t.{f}"), F.lit("")), other)
    at = F.concat_ws("/", "folder", given("dir", F.col("t.id")), given("gold", F.lit("gold.json")))
    items = items.select("suite", "split", "place", F.col("t.id").alias("item"), F.col("t.stratum").alias("stratum"), at.alias("gold_path"))
    gold = spark.read.schema(GOLD).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(manifest.rsplit("/", 1)[0])
    return items.join(gold.select(F.col("_metadata.file_path").alias("gold_path"), F.struct(*gold.columns).alias("gold")), "gold_path", "left")


def judge_runs(spark: SparkSession, root: str) -> DataFrame:
    """SRC-12: judge.json of every run directory under root. A record without an outcome, or with a pair of other than two, raises."""
    read = spark.read.schema(JUDGED).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "judge.json").json(root)
    pairs = F.coalesce("pairs", F.array().cast(dict(read.dtypes)["pairs"]))
    fine = (F.coalesce("outcome.kind", F.lit("")) != "") & F.forall(pairs, lambda p: F.coalesce(F.size(p["pair"]), F.lit(0)) == 2)
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return checked(read, fine, "malformed judge record").select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/judge\.json$", 1).alias("run_id"), F.col("outcome.kind").alias("outcome"), F.col("outcome.candidate_id").alias("candidate"),
        F.col("outcome.reason").alias("reason"), F.col("consensus.agreement").alias("consensus"), F.col("tie_break.key").alias("tie_break"),
        none("swap_consistent_pairs"), none("invalid_output_retries"), none("latency_ms"), pairs.alias("pairs"),
    )


def judge_orders(runs: DataFrame) -> DataFrame:
    """SRC-12: a row for each call of judge_runs: pair, order and answer."""
    pairs = runs.select("run_id", F.posexplode("pairs").alias("pair_id", "p"))
    orders = pairs.select("run_id", "pair_id", F.col("p.verdict").alias("verdict"), F.col("p.draw_reason").alias("draw_reason"), F.posexplode("p.orders").alias("ord", "o"))
    return orders.select("run_id", "pair_id", "verdict", "draw_reason", "ord", "o.*")


def doctor_runs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16: a row for each run of the doctor reports at path; another version, no run_id and no runs raise."""
    read = spark.read.schema(DOCTOR).option("multiLine", True).json(path)
    fine = (F.col("schema_version") == 1) & (F.col("run_id") != "") & (F.size("runs") > 0)
    return checked(read, fine, "malformed report").select("run_id", F.col("task").alias("report_task"), "rev", "verdict", F.posexplode("runs").alias("place", "r")).select("run_id", "report_task", "rev", "verdict", "place", "r.*")


def verify_result(printed: Column) -> Column:
    """SRC-17: the struct that a verifier printed as JSON; nothing printed, another version or a state outside the vocabulary raise."""
    r = F.from_json(printed, RESULT)
    fine = (F.length(F.trim(printed)) > 0) & (r["schema_version"] == 1) & r["status"].isin(*STATUSES)
    return F.when(F.assert_true(F.coalesce(fine, F.lit(False)), F.concat(F.lit("malformed verify result: "), F.coalesce(printed, F.lit("null")))).isNull(), r)


def band_rows(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18: a verifier's CSV block with its header; absent numbers are null, and other columns raise."""
    fields = "invariant string, value double, ci_half double, band_lo double, band_hi double, verdict string"
    return spark.read.schema(fields).options(header=True, enforceSchema=False, mode="FAILFAST").csv(path)


def labels(spark: SparkSession, path: str, choices: list[str]) -> DataFrame:
    """SRC-10: labels whose choice is in the vocabulary; another raises."""
    df = jsonl(spark, path, "item string, labeler string, presented array<string>, choice string, at timestamp, duration_ms bigint, note string", strict=True)
    return df.where(F.assert_true(F.col("choice").isin(choices), F.lit("unknown choice")).isNull())


def frontmatter(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: path, scalar attributes (map), list attributes (map) and body of Markdown files with a head between --- lines.

    Heads are flat: `key: value` and `key:` followed by `- value` lines."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    head, body = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n?(.*)\z", 1), F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n?(.*)\z", 2)
    clean = lambda c: F.btrim(F.trim(c), F.lit("\"'"))
    keys = F.regexp_extract_all("head", F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(\S.*)$"), F.lit(1))
    values = F.transform(F.regexp_extract_all("head", F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(\S.*)$"), F.lit(2)), clean)
    list_keys = F.regexp_extract_all("head", F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*\n((?:[ \t]*- .*(?:\n|$))+)"), F.lit(1))
    list_values = F.regexp_extract_all("head", F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*\n((?:[ \t]*- .*(?:\n|$))+)"), F.lit(2))
    items: Column = F.transform(list_values, lambda b: F.transform(F.regexp_extract_all(b, F.lit(r"(?m)^[ \t]*- (.*)$"), F.lit(1)), clean))
    return text.select("path", head.alias("head"), body.alias("body")).select(
        "path", F.map_from_arrays(keys, values).alias("attrs"), F.map_from_arrays(list_keys, items).alias("list_attrs"), "body", (F.col("head") != "").alias("has_frontmatter")
    )


def heads(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: path, head (its nested values as JSON), body, and fault (no-head, malformed) of Markdown files with a head between --- lines."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    shape = r"(?s)\A---\n(.*?\n|)---(?:\n(.*))?\z"
    has = F.col("value").rlike(shape)
    cut = text.select("path", F.when(has, F.regexp_extract("value", shape, 1)).alias("written"), F.when(has, F.regexp_extract("value", shape, 2)).otherwise(F.col("value")).alias("body"))
    read = cut.select("path", head_json(F.col("written")).alias("head"), "body", F.col("written").isNull().alias("none"))
    return read.select("path", "head", "body", F.when(F.col("none"), "no-head").when(F.col("head").isNull(), "malformed").alias("fault"))
