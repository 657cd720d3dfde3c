"""Failure patterns mined from recorded traces: rules as predicates, one pass over the joined trace, then buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import http_reason, tidy


# Messages of git apply, read in this order, one reading a failure; words that ask for tests; files of tests.
DRIFT, HUNK, SCOPE = "patch does not apply", "corrupt patch at line", "already exists|No such file or directory|new file"
ASKS_FOR_TESTS, TEST_FILE = r"(?i)\btests?\b|_test\.go", r"_test\.go$"
# What each rule's pattern is called, its category, the surface that an edit would touch, and whether buckets keep to one task.
PATTERNS = {
    "R1": ("no-diff-emitted", "not-provided", "system-prompt", False),
    "R2": ("non-completion-response", "not-provided", "tool-description", False),
    "R3": ("context-lines-drift", "unsafe-provided", "memory", True),
    "R4": ("malformed-hunk", "unsafe-provided", "memory", True),
    "R5": ("out-of-scope-path", "unsafe-provided", "memory", True),
    "R6": ("task-specific-knowledge-gap", "unsafe-provided", "memory", True),
    "R7": ("instruction-underspecified", "not-provided", "memory", True),
    "R8": ("proposer-budget-exceeded", "wrong-duration", "middleware", False),
    "R9": ("verify-budget-exceeded", "wrong-duration", "middleware", True),
    "R10": ("completion-truncated", "wrong-duration", "system-prompt", False),
    "R11": ("edits-unlisted-file", "unsafe-provided", "system-prompt", True),
    "R12": ("edits-the-tests", "unsafe-provided", "system-prompt", True),
    "R13": ("single-proposer-dependence", "not-provided", "subagent-config", True),
    "R14": ("persistent-band-breach", "wrong-timing", "middleware", True),
    "R16": ("request-rejected-by-server", "unsafe-provided", "system-prompt", False),
}


@dataclass(frozen=True)
class Rule:
    """id, condition, bucket key and the fewest proposers of the run."""

    id: str
    fires: Column
    min_pool: int = 1
    key: Column | None = None

    def described(self) -> list[Column]:
        names = ("slug", "category", "component", "scoped")
        return [F.lit(self.id).alias("rule"), *(F.lit(x).alias(n) for x, n in zip(PATTERNS[self.id], names, strict=True))]


def registry() -> list[Rule]:
    """R1 to R16; R15 is counted apart. Columns are those of joined()."""
    s, v, message = F.col("status"), F.col("verify_status"), F.coalesce("apply_error", F.lit(""))
    failed = v == "apply_failed"
    drift, hunk = message.rlike(DRIFT), message.rlike(HUNK)
    reason = http_reason(F.col("error"))
    return [
        Rule("R1", s == "no_diff"),
        Rule("R2", s == "malformed"),
        Rule("R3", failed & drift),
        Rule("R4", failed & ~drift & hunk),
        Rule("R5", failed & ~drift & ~hunk & message.rlike(SCOPE)),
        Rule("R6", (v == "fail") & (F.coalesce("exit_code", F.lit(0)) != 0) & F.col("run_passed"), min_pool=2),
        Rule("R7", (F.col("run_ok") > 0) & (F.col("run_failed") == F.col("run_ok")) & (s == "ok") & F.col("no_candidate"), min_pool=2),
        Rule("R8", s == "timeout"),
        Rule("R9", v == "timeout"),
        Rule("R10", (s == "ok") & (F.col("finish_reason") == "length")),
        Rule("R11", (F.size("task_files") > 0) & (F.size(F.array_except("diff_files", "task_files")) > 0)),
        Rule("R12", F.exists("diff_files", lambda f: f.rlike(TEST_FILE)) & ~F.coalesce(F.col("instruction").rlike(ASKS_FOR_TESTS), F.lit(True))),
        Rule("R13", (F.col("selected") == F.col("proposer_id")) & (F.size("also_passed") == 0), min_pool=2),
        Rule("R14", F.size("band_failed") > 0, key=F.explode(F.array_distinct("band_failed"))),
        Rule("R16", (s == "http_error") & reason.isNotNull(), key=reason),
    ]


def joined(candidates: DataFrame, verifies: DataFrame, runs: DataFrame, selections: DataFrame) -> DataFrame:
    """JN-01: candidates with their verification, run and selection, and what holds over the run.

    A run has no candidate if its selection's kind says so; where selections have no kind, if it has no selected one."""
    if "kind" in selections.columns:
        selections = selections.withColumn("no_candidate", F.col("kind") == "no_candidate").drop("kind")
    else:
        selections = selections.withColumn("no_candidate", F.col("selected").isNull())
        selections = runs.select("run_id").distinct().join(selections, "run_id", "left").withColumn("no_candidate", F.coalesce("no_candidate", F.lit(True)))
    w = Window.partitionBy("run_id")
    rows = (
        candidates.join(verifies, ["run_id", "proposer_id"], "left").join(runs, "run_id").join(selections, "run_id", "left")
        .withColumns({"also_passed": F.coalesce("also_passed", F.array().cast("array<string>")), "band_failed": F.coalesce("band_failed", F.array().cast("array<string>"))})
    )
    return rows.withColumns(
        {
            "no_candidate": F.coalesce("no_candidate", F.lit(False)),
            "run_passed": F.coalesce(F.max((F.col("verify_status") == "pass").cast("int")).over(w), F.lit(0)) == 1,
            "run_ok": F.count_if(F.col("status") == "ok").over(w),
            "run_failed": F.count_if((F.col("status") == "ok") & (F.col("verify_status") == "fail")).over(w),
            "pool": F.when(F.col("configured") > 0, F.col("configured")).otherwise(F.count("*").over(w)),
        }
    )


def observations(rows: DataFrame) -> DataFrame:
    """One row for each rule that fires on a candidate: rule, slug, category, component, task (of task-scoped rules), key, run and proposer."""
    base, plain, keyed = ["run_id", "proposer_id", "task_id", "pool"], [], []
    for r in registry():
        (keyed if r.key is not None else plain).append(r)
    fired = [F.when(F.coalesce(r.fires, F.lit(False)) & (F.col("pool") >= r.min_pool), F.struct(*r.described())) for r in plain]
    out = rows.select(*base, F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("r")).select(*base, "r.*", F.lit("").alias("key"))
    for r in keyed:
        out = out.union(rows.where(F.coalesce(r.fires, F.lit(False))).select(*base, *r.described(), r.key))
    return out.withColumn("task", F.when(F.col("scoped"), F.col("task_id"))).drop("task_id", "scoped")


def buckets(obs: DataFrame, min_runs: int = 2, min_proposers: int = 1) -> DataFrame:
    """AG-37: buckets by signature that reach the thresholds."""
    out = obs.groupBy("rule", "slug", "category", "component", "task", "key").agg(
        F.countDistinct("run_id").alias("runs"), F.countDistinct("proposer_id").alias("proposers"), F.count("*").alias("n"), F.min("pool").alias("min_pool")
    )
    return out.where((F.col("runs") >= min_runs) & (F.col("proposers") >= min_proposers))


def not_mined(rows: DataFrame, most: int = 8, length: int = 160) -> DataFrame:
    """R15, AG-38: http errors that are not refusals: how many, their first distinct texts, tidied, and how many more there are."""
    errors = rows.where((F.col("status") == "http_error") & http_reason(F.col("error")).isNull()).groupBy(tidy(F.col("error"), length).alias("text")).agg(F.count("*").alias("n"))
    counts = errors.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("text").alias("_texts"))
    first = errors.where("text is not null").orderBy("text").limit(most).agg(F.array_sort(F.collect_list("text")).alias("_first"))  # at most `most` rows
    more = F.when(F.col("_texts") > most, F.concat(F.lit("; and "), (F.col("_texts") - most).cast("string"), F.lit(" more"))).otherwise("")
    return counts.crossJoin(F.broadcast(first)).select("n", F.concat(F.array_join("_first", "; "), more).alias("texts"))  # two tables of one row


def plan_upsert(mined: DataFrame, existing: DataFrame) -> DataFrame:
    """SNK-03: what becomes of each pattern: create, append, unchanged, skip-closed or, where its document does not tell its
    status, unreadable; known patterns that were not mined are absent. And the evidence it then has.

    mined: slug, evidence; existing: slug, status, evidence."""
    j = mined.withColumn("is_mined", F.lit(True)).alias("m").join(existing.withColumn("is_known", F.lit(True)).alias("e"), "slug", "full")
    none = F.array().cast("array<string>")
    old, new = F.coalesce("e.evidence", none), F.coalesce("m.evidence", none)
    action = (
        F.when(F.col("is_known").isNull(), "create").when(F.col("e.status").isNull(), "unreadable").when(F.col("is_mined").isNull(), "absent")
        .when(F.col("e.status").isin("resolved", "withdrawn"), "skip-closed").when(F.size(F.array_except(new, old)) == 0, "unchanged").otherwise("append")
    )
    return j.select("slug", action.alias("action"), F.array_sort(F.array_distinct(F.array_union(old, new))).alias("evidence"))
