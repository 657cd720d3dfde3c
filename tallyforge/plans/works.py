"""Queries of diffs, edits, packets, and canonical digests, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import canonical, text
from tallyforge.operators import agreement as ag
from tallyforge.operators import diffs, packets, pairwise, trials
from tallyforge.operators import validity as va
from tallyforge.plans.registry import View, query


@query()
def SC15_line_diffs(v: View) -> DataFrame:
    """Every page against the next one: the hunks' digest and what they add and take."""
    p = v("pages")
    pairs = p.select("page_id", F.col("html").alias("before")).join(p.select((F.col("page_id") - 1).alias("page_id"), F.col("html").alias("after")), "page_id")
    d = diffs.line_diffs(pairs, "before", "after")
    lines = lambda mark: F.size(F.filter("diff", lambda x: x.startswith(mark))).cast("long")
    return d.select("page_id", lines("@@ ").alias("hunks"), lines("+").alias("added"), lines("-").alias("taken"), F.sha2(F.array_join("diff", "\n"), 256).alias("digest"))


PATH = """CASE doc_id % 6 WHEN 0 THEN 'memory/d' || doc_id || '.md' WHEN 1 THEN 'system-prompt.md' WHEN 2 THEN 'skills/s' || doc_id || '/SKILL.md' WHEN 3 THEN 'src/d' || doc_id || '.go'
WHEN 4 THEN 'memory/new' || doc_id || '.md' ELSE 'memory/d' || doc_id || '.md' END"""


@query(f"""WITH d AS (SELECT a.doc_id, {PATH.replace("doc_id", "a.doc_id")} AS path, a.doc_id % 6 AS k, coalesce(a.text, '') || chr(10) AS before, coalesce(b.text, '') || chr(10) AS after
  FROM (SELECT doc_id, any_value(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) = 1) a
  JOIN (SELECT doc_id, any_value(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) = 1) b ON b.doc_id = a.doc_id + 1),
r AS (SELECT *, CASE WHEN k <> 4 AND before = after THEN 'not-applicable' WHEN k = 3 THEN 'misplaced' WHEN k <> 1 AND regexp_full_match(after, '\\s*') THEN 'empty' WHEN k <> 1 AND contains(after, chr(9)) THEN 'tab' END AS refusal FROM d)
SELECT doc_id, refusal, CASE WHEN refusal IS NULL THEN CASE WHEN k = 1 THEN 'system-prompt' WHEN k = 2 THEN 'skill' ELSE 'memory' END END AS component, CASE WHEN refusal IS NULL THEN CASE WHEN k = 1 THEN 'human' ELSE 'auto' END END AS approval,
CASE WHEN refusal IS NULL THEN path END AS path, CASE WHEN refusal IS NULL THEN CASE WHEN k = 1 THEN 'amend' WHEN k = 4 THEN 'add' ELSE 'rewrite' END END AS verb,
CASE WHEN refusal IS NULL AND k <> 1 THEN sha256(trim(replace(after, chr(13) || chr(10), chr(10)), chr(10))) END AS body_sha256 FROM r""")
def CE01_candidate_edits(v: View) -> DataFrame:
    """Candidates whose diffs turn each document's text into the next one's: read, applied to the harness that holds the first, and made edits of."""
    whole = v("documents").where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.first("text").alias("text")).where("n = 1")
    ended = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    pairs = whole.select("doc_id", ended.alias("before")).join(whole.select((F.col("doc_id") - 1).alias("doc_id"), ended.alias("after")), "doc_id").withColumn("path", F.expr(PATH))
    fresh = F.col("doc_id") % 6 == 4
    d = diffs.line_diffs(pairs.withColumn("before", F.when(~fresh, F.col("before"))), "before", "after")
    head = F.concat(F.lit("--- "), F.when(fresh, "/dev/null").otherwise(F.concat(F.lit("a/"), "path")), F.lit("\n+++ b/"), "path", F.lit("\n"))
    made = d.select(F.col("doc_id").alias("id"), F.lit("ok").alias("status"), F.col("doc_id").alias("harness"), F.when(F.size("diff") > 0, F.concat(head, F.array_join("diff", "\n"))).otherwise("no hunk").alias("diff"))
    harness = d.where("before is not null").select(F.col("doc_id").alias("harness"), "path", F.col("before").alias("body"))
    e = diffs.edits(made, harness)
    return e.select(F.col("id").alias("doc_id"), "refusal", "component", "approval", F.get("paths", F.lit(0)).alias("path"), "verb", F.sha2("body", 256).alias("body_sha256"))


def _packet(v: View) -> DataFrame:
    return packets.packet(v("part").select(F.floor(F.col("p_partkey") / 3).alias("item"), F.col("p_partkey").alias("candidate"), F.col("p_name").alias("body")), "ann", "key")


@query("""SELECT item, count(*) AS candidates, string_agg(label || p_partkey, ',' ORDER BY p_partkey) AS labels FROM (SELECT floor(p_partkey / 3)::BIGINT AS item, p_partkey,
chr((64 + row_number() OVER (PARTITION BY floor(p_partkey / 3) ORDER BY sha256('key|ann|' || floor(p_partkey / 3)::BIGINT || '|' || p_partkey)))::INT) AS label FROM part) x GROUP BY item""")
def LP01_packets(v: View) -> DataFrame:
    named = F.transform(F.array_sort(F.collect_list(F.struct("candidate", "label"))), lambda x: F.concat(x["label"], x["candidate"].cast("string")))
    return _packet(v).groupBy("item").agg(F.count("*").alias("candidates"), F.array_join(named, ",").alias("labels"))


@query("""WITH p AS (SELECT floor(p_partkey / 3)::BIGINT AS item, p_partkey, p_size, max(p_size) OVER (PARTITION BY floor(p_partkey / 3)) AS top FROM part),
a AS (SELECT item, list_sort(list(p_partkey::VARCHAR) FILTER (p_size > 20)) AS good FROM p GROUP BY item)
SELECT item, CASE item % 9 WHEN 1 THEN 'unanswered' WHEN 2 THEN 'repeated-item' WHEN 3 THEN 'annotator' WHEN 4 THEN 'packet-changed' WHEN 5 THEN 'mapping-changed' WHEN 6 THEN 'no-rationale' WHEN 7 THEN 'unknown-label'
WHEN 8 THEN 'choice' END AS refusal, CASE WHEN item % 9 = 0 THEN array_to_string(coalesce(good, []), ',') END AS acceptable, CASE WHEN item % 9 = 0 THEN good IS NULL END AS all_bad FROM a""")
def LP02_imported_answers(v: View) -> DataFrame:
    """Answers that accept the candidates of size over 20, tampered with in eight ways by item."""
    made = _packet(v)
    sized = made.join(v("part").select(F.col("p_partkey").alias("candidate"), "p_size"), "candidate")
    good = F.array_sort(F.collect_list(F.when(F.col("p_size") > 20, F.col("label"))))
    one = sized.groupBy("item").agg(good.alias("acceptable"), *(F.first(c).alias(c) for c in ("annotator", "packet_sha256", "mapping_sha256")))
    kind: Column = F.col("item") % 9
    swap = lambda k, column, value: F.when(kind == k, F.lit(value)).otherwise(F.col(column)).alias(column)
    answers = one.where(kind != 1).select(
        "item", swap(3, "annotator", "else"), swap(4, "packet_sha256", "0"), swap(5, "mapping_sha256", "0"),
        F.when(kind == 7, F.array(F.lit("ZZ"))).otherwise(F.col("acceptable")).alias("acceptable"),
        F.when(kind == 8, F.size("acceptable") > 0).otherwise(F.size("acceptable") == 0).alias("all_bad"), F.when(kind == 6, " ").otherwise("read").alias("rationale"),
    )
    twice = answers.union(answers.where(F.col("item") % 9 == 2))
    found = packets.import_answers(made, twice)
    return found.select("item", "refusal", F.array_join("acceptable", ",").alias("acceptable"), "all_bad")


@query("""SELECT o_orderkey AS run, CASE WHEN o_custkey % 7 <> 0 THEN sha256('{"extra_body":{"z":[1,2,{"b":"x y","a":null}],"a":true}' || CASE WHEN o_custkey % 2 = 0 THEN ',"max_tokens":512' ELSE '' END
|| ',"model":"m\\u003c' || o_custkey % 5 || '\\u003e \\u0026 co","temperature":' || CASE o_custkey % 3 WHEN 0 THEN '0.70' WHEN 1 THEN '1e0' ELSE '0' END || '}') END AS digest FROM orders""")
def SC17_judge_digests(v: View) -> DataFrame:
    return v("judge_settings").select("run", canonical.settings_digest(F.col("settings")).alias("digest"))


@query("""SELECT run, sha256('{"task_sha256":"' || task || '","conversation_sha256":"",' || CASE WHEN rubric IS NOT NULL THEN '"rubric_sha256":"r\\u003c1\\u003e",' ELSE '' END
|| CASE WHEN reference <> '' THEN '"reference_sha256":"ref\\u0026",' ELSE '' END || '"candidates_sha256":"c","prompt_version":"' || prompt_version || '","cmoa_version":"v","selection_rule":"s","judge_sha256":"j","allow_tie":'
|| CASE WHEN allow_tie THEN 'true' ELSE 'false' END || ',"seed":' || seed || ',"judge_seed":' || k || '}') AS digest FROM reuse_keys""")
def JN15_reuse_digests(v: View) -> DataFrame:
    fixed = {"candidates": F.lit("c"), "cmoa_version": F.lit("v"), "selection_rule": F.lit("s"), "judge": F.lit("j"), "conversation": F.lit(None).cast("string"), "judge_seed": F.col("k")}
    return v("reuse_keys").select("run", canonical.reuse_digest({p: fixed.get(p, F.col(p) if p not in fixed else None) for p, _ in canonical.REUSE_PARTS}).alias("digest"))


LABELLED = """f AS (SELECT item, choice FROM (SELECT item, choice, row_number() OVER (PARTITION BY item ORDER BY labeler, choice) k FROM human_labels) x WHERE k = 1),
ref AS (SELECT coalesce(f.item, g.item) AS item, CASE WHEN coalesce(choice, gold) IN ('tie', 'all_bad') THEN 'abstain' ELSE coalesce(choice, gold) END AS gold FROM f FULL JOIN gold g ON f.item = g.item)"""


@query(f"""WITH {LABELLED}, j AS (SELECT seed, gold, outcome, CASE WHEN gold IS NULL THEN NULL WHEN outcome = 'selected' THEN CASE WHEN candidate = gold THEN 'selected_agrees' ELSE 'selected_differs' END
  WHEN outcome = 'no_candidate' THEN coalesce(nullif(reason, ''), 'unstated') ELSE outcome END AS o FROM judged LEFT JOIN ref ON judged.item = ref.item),
b AS (SELECT 'all' AS t, NULL::BIGINT AS seed, gold, outcome, o FROM j UNION ALL SELECT 'seed', seed, gold, outcome, o FROM j),
s AS (SELECT t, seed, count(gold) AS runs, count(*) - count(gold) AS ungolded, count(*) FILTER (gold <> 'abstain' AND outcome = 'no_candidate') AS abstained_on_decided FROM b GROUP BY ALL)
SELECT s.seed, o AS outcome, count(*) FILTER (gold <> 'abstain') AS gold_decided, count(*) FILTER (gold = 'abstain') AS gold_tie, any_value(runs) AS runs, any_value(ungolded) AS ungolded, any_value(abstained_on_decided) AS abstained_on_decided
FROM s JOIN b ON s.t = b.t AND s.seed IS NOT DISTINCT FROM b.seed AND o IS NOT NULL GROUP BY s.t, s.seed, o""")
def AG18_coverage_table(v: View) -> DataFrame:
    runs = v("judged").withColumn("category", va.category(F.col("outcome"), F.col("candidate")))
    return ag.coverage_table(runs, va.references(v("human_labels"), v("gold")))


CARDS = [(f"{s}-{k}-{n}-{m}", s, k, n, m) for s in "ABC" for k in ("speed", "quality", "output-fix") for n, m in ((1, 1), (100_000, 1), (1, 100_000))]


@query(f"""WITH cards(card, stage, kind, floor_, per) AS (VALUES {", ".join(map(str, CARDS))}), i AS (SELECT *, coalesce(reference, '') <> '' AND base IS NOT NULL AND candidate IS NOT NULL AS ok FROM trial_items),
q AS (SELECT set_name AS basis, count(*) FILTER (ok) AS n, round(100 * (avg(candidate) FILTER (ok) - avg(base) FILTER (ok)), 3) AS raw FROM i GROUP BY set_name),
m AS (SELECT count(*) FILTER (ok AND base = 1 AND candidate = 0) AS w, count(*) FILTER (ok AND base = 0 AND candidate = 1) AS r FROM i WHERE set_name IN ('D', 'R')),
t AS (SELECT avg(candidate_s) / avg(base_s) AS ratio FROM i), s AS (SELECT lang AS stratum, length(lang) * 0.1 AS share FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) x),
b AS (SELECT stratum, count(*) AS n, avg(base) AS b, avg(candidate) AS c FROM i WHERE ok AND set_name = 'D' GROUP BY stratum),
g AS (SELECT min(coalesce(n, 0)) AS fewest, round(100 * (sum(share * c) - sum(share * b)) / sum(share), 3) AS weighted FROM s LEFT JOIN b USING (stratum)),
x AS (SELECT card, stage, kind, CASE stage WHEN 'C' THEN 'H' ELSE 'D' END AS basis, floor_, per FROM cards),
y AS (SELECT x.*, coalesce(n, 0) AS n, w, r, ratio, CASE WHEN coalesce(n, 0) = 0 THEN 'none-evaluable' WHEN n < floor_ THEN 'below-floor' WHEN x.basis = 'D' AND fewest < per THEN 'thin-stratum' END AS why_not,
  CASE x.basis WHEN 'D' THEN weighted ELSE raw END AS p, CASE stage WHEN 'A' THEN 'advance' ELSE 'finalist' END AS adv, CASE kind WHEN 'speed' THEN -2.0 WHEN 'quality' THEN 3.0 ELSE 0.0 END AS lq,
  CASE kind WHEN 'speed' THEN 0.90 WHEN 'quality' THEN 1.05 ELSE 0.0 END AS lt FROM x LEFT JOIN q ON x.basis = q.basis, m, t, g)
SELECT card, basis, n AS evaluable, why_not IS NULL AS measured, why_not, round(CASE WHEN why_not IS NULL THEN p END, 6) AS points, w AS newly_wrong, r AS newly_right, round(ratio, 6) AS ratio,
CASE WHEN stage = 'A' AND w - r >= 2 THEN 'drop' WHEN why_not IS NOT NULL THEN 'inconclusive' WHEN kind = 'output-fix' THEN CASE WHEN p >= lq THEN adv ELSE 'drop' END
WHEN p >= lq AND ratio <= lt THEN adv WHEN p < lq AND ratio > lt THEN 'drop' ELSE 'inconclusive' END AS decision FROM y""")
def AG34_card_suggestions(v: View) -> DataFrame:
    """One trial under cards of every stage, kind and floor; its D stands for a population of languages weighted by their names' lengths."""
    spark = v("region").sparkSession
    cards = spark.createDataFrame(CARDS, "card string, stage string, kind string, min_evaluable int, min_per_stratum int")
    weights = v("documents").where("lang is not null").select(F.col("lang").alias("stratum")).distinct().withColumn("share", F.length("stratum") * F.lit(0.1))
    return trials.card_suggestions(v("trial_items").withColumnRenamed("set_name", "set"), cards, weights)


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) k, count(*) OVER () n FROM part), b AS (SELECT *, CASE WHEN k <= round(n * 0.4) THEN 'clear' WHEN k <= round(n * 0.4) + round(n * 0.3) THEN 'close' ELSE 'rest' END AS stratum FROM r),
s AS (SELECT stratum, p_partkey, row_number() OVER (PARTITION BY stratum ORDER BY sha256('1|' || p_partkey)) AS i, n // 7 AS target FROM b),
w AS (SELECT *, CASE stratum WHEN 'clear' THEN round(0.4 * target) WHEN 'close' THEN round(0.3 * target) ELSE target - round(0.4 * target) - round(0.3 * target) END AS want FROM s)
SELECT stratum, p_partkey FROM w WHERE i <= want""")
def WN06_stratified_sample(v: View) -> DataFrame:
    """A seventh of all parts, by strata of size."""
    shares = {"clear": 0.4, "close": 0.3, "rest": 0.3}
    part = v("part")
    banded = pairwise.stratify(part.select("p_partkey", "p_size"), "p_size", ["p_partkey"], shares)
    return pairwise.stratified_sample(banded, "stratum", "p_partkey", shares, part.count() // 7).select("stratum", "p_partkey")


@query("""WITH n AS (SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE (o_custkey % 2 * 2 - 1) * round(o_totalprice * 100)::BIGINT END AS cents FROM orders), t AS (SELECT *, rtrim(lpad((abs(cents) % 10000)::VARCHAR, 4, '0'), '0') AS f FROM n)
SELECT o_orderkey, CASE WHEN cents < 0 THEN '-' ELSE '' END || (abs(cents) // 10000)::VARCHAR || '.' || CASE WHEN f = '' THEN '0' ELSE f END AS shown FROM t""")
def SC06_numbers(v: View) -> DataFrame:
    cents = F.when(F.col("o_custkey") % 9 == 0, 0).otherwise((F.col("o_custkey") % 2 * 2 - 1) * F.round(F.col("o_totalprice") * 100).cast("long"))
    return v("orders").select("o_orderkey", text.number(cents.cast("double") / 10000).alias("shown"))


@query("""SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN CASE WHEN event_type = 'signup' THEN 'verifier_error' ELSE 'none' END WHEN user_id % 11 = 0 THEN 'timeout' WHEN user_id % 6 = 0 THEN 'infra'
WHEN user_id % 6 - 2 IN (2, 3) THEN 'harness_crash' WHEN user_id % 6 - 2 = -1 THEN 'timeout' ELSE 'infra' END AS class FROM events""")
def PRJ12_error_classes(v: View) -> DataFrame:
    code = F.when(F.col("user_id") % 6 != 0, F.col("user_id") % 6 - 2)
    c = text.error_class(F.col("event_type").isin("error", "view"), F.when(F.col("user_id") % 11 == 0, F.lit(True)), code, F.col("event_type") == "signup")
    return v("events").select("event_id", c.alias("class"))


FAILURE = """concat(CASE user_id % 3 WHEN 0 THEN '' ELSE concat('error: f', CAST(user_id % 7 AS VARCHAR(9)), '.go: patch does not apply', chr(10)) END, 'error: no such thing', chr(10),
CASE WHEN user_id % 5 = 0 THEN 'error: a.go: patch does not apply' ELSE 'warning: b.go: patch does not apply' END)"""


@query(f"""WITH e AS (SELECT event_id, regexp_extract_all({FAILURE}, '(?m)^error: ([^:\n]+): patch does not apply$', 1) AS f, event_type AS touched FROM events)
SELECT event_id, array_to_string(list_sort(list_distinct(CASE WHEN len(f) > 0 THEN f ELSE [touched] END)), ',') AS files FROM e""")
def SC03_failed_files(v: View) -> DataFrame:
    e = v("events").select("event_id", F.expr(FAILURE).alias("error"), F.array("event_type").alias("touched"))
    return e.select("event_id", F.array_join(text.failed_files(F.col("error"), F.col("touched")), ",").alias("files"))


MISMATCH = ", ".join(f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in ("task", "rubric", "reference", "prompt_version", "allow_tie", "seed"))


@query(f"""SELECT a.run, b.run IS NOT NULL AND len(list_filter([{MISMATCH}], lambda x: x IS NOT NULL)) = 0 AS reused, CASE WHEN b.run IS NOT NULL THEN array_to_string(list_filter([{MISMATCH}], lambda x: x IS NOT NULL), ',') END AS mismatches
FROM reuse_keys a LEFT JOIN reuse_keys b ON b.run = a.run + 32""")
def JN15_AG46_key_parts(v: View) -> DataFrame:
    """Every run against the saved one of 32 keys on, by all twelve parts in order."""
    from tallyforge.operators.matching import reuse

    parts = [p for p, _ in canonical.REUSE_PARTS]
    full = v("reuse_keys").select("run", *(F.col(p) if p in ("task", "rubric", "reference", "prompt_version", "allow_tie", "seed") else F.lit("same").alias(p) for p in parts))
    return reuse(full, full.withColumn("run", F.col("run") - 32), "run", parts).select("run", "reused", "mismatches")
