"""Names every registered query of the evaluation operators and its oracle SQL. Doubles are rounded to 6 places on both sides."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import agreement as ag
from tallyforge.operators import graph, mining, pairwise, selection, sequential, trials, verifiers
from tallyforge.plans import records, works  # noqa: F401 - they register their queries
from tallyforge.plans.registry import REGISTRY, View, query, rounded
from tallyforge.plans.views import load, oracle

FLAGSHIP = "AG02_agreement"
Z = repr(NormalDist().inv_cdf(0.975))
KINDS = ["click", "error", "purchase", "signup", "view"]
DAY = "1996-06-01"
SHARES = {"clear": 0.4, "close": 0.3, "rest": 0.3}

KAPPA = f"""
WITH c AS (SELECT cluster, count(*) n, count(*) FILTER (first = second) same, count(*) FILTER (first = 'no') f0, count(*) FILTER (first = 'yes') f1,
    count(*) FILTER (second = 'no') s0, count(*) FILTER (second = 'yes') s1 FROM agreement_rows GROUP BY cluster),
t AS (SELECT sum(n) n, sum(same) same, sum(f0) f0, sum(f1) f1, sum(s0) s0, sum(s1) s1, count(*) g FROM c),
r AS (SELECT (t.same - c.same)::DOUBLE / (t.n - c.n) po, ((t.f0 - c.f0) * (t.s0 - c.s0) + (t.f1 - c.f1) * (t.s1 - c.s1))::DOUBLE / ((t.n - c.n) * (t.n - c.n)) pe FROM c, t),
v AS (SELECT var_pop((po - pe) / (1 - pe)) v FROM r),
k AS (SELECT n, g, same::DOUBLE / n po, (f0 * s0 + f1 * s1)::DOUBLE / (n * n) pe FROM t),
h AS (SELECT k.*, (po - pe) / (1 - pe) kap, {Z} * sqrt(v * (g - 1)) half FROM k, v)
SELECT n::BIGINT AS n, g AS clusters, round(po, 6) AS p_o, round(pe, 6) AS p_e, round(kap, 6) AS kappa, round(2 * po - 1, 6) AS pabak,
    round(greatest(-1.0, kap - half), 6) AS kappa_lo, round(least(1.0, kap + half), 6) AS kappa_hi FROM h"""


@query("SELECT a.first, b.second, coalesce(n, 0) AS n FROM (VALUES ('no'), ('yes')) a(first) CROSS JOIN (VALUES ('no'), ('yes')) b(second) "
       "LEFT JOIN (SELECT first, second, count(*) n FROM agreement_rows GROUP BY ALL) x ON x.first = a.first AND x.second = b.second")  # fmt: skip
def AG01_contingency(v: View) -> DataFrame:
    return ag.contingency(v("agreement_rows"), "first", "second", ["no", "yes"])


@query(KAPPA)
def AG02_agreement(v: View) -> DataFrame:
    return ag.agreement(v("agreement_rows"), "first", "second", "cluster", ["no", "yes"])


@query(f"""WITH c AS (SELECT user_id, count(*) FILTER (first = second) s, count(*) n FROM rater_pairs GROUP BY user_id),
t AS (SELECT sum(s) s, sum(n) n, count(*) g FROM c), v AS (SELECT var_pop((t.s - c.s)::DOUBLE / nullif(t.n - c.n, 0)) v FROM c, t)
SELECT s::BIGINT AS successes, n::BIGINT AS trials, round(s::DOUBLE / n, 6) AS rate, round(greatest(0, s::DOUBLE / n - {Z} * sqrt(v * (g - 1))), 6) AS lo,
round(least(1, s::DOUBLE / n + {Z} * sqrt(v * (g - 1))), 6) AS hi FROM t, v""")
def AG04_clustered_proportion(v: View) -> DataFrame:
    return ag.clustered_proportion(v("rater_pairs"), F.col("first") == F.col("second"), "user_id")


@query(f"""WITH c AS (SELECT cluster, count(*) FILTER (first = second) s, count(*)::DOUBLE n FROM agreement_rows GROUP BY cluster),
w AS (SELECT *, s / n p, 1 + {Z}*{Z}/n b FROM c)
SELECT cluster, s AS successes, n::BIGINT AS trials, round(p, 6) AS rate,
round(greatest(0, (p + {Z}*{Z}/(2*n)) / b - {Z} * sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n)) / b), 6) AS lo,
round(least(1, (p + {Z}*{Z}/(2*n)) / b + {Z} * sqrt(p*(1-p)/n + {Z}*{Z}/(4*n*n)) / b), 6) AS hi FROM w""")
def AG05_wilson(v: View) -> DataFrame:
    return ag.proportions(v("agreement_rows"), "cluster", F.col("first") == F.col("second"))


@query("""WITH c AS (SELECT stratum, cluster, avg(candidate - base) m FROM trial_items GROUP BY ALL HAVING bool_and(candidate - base IS NOT NULL)),
s AS (SELECT stratum, count(*) n, avg(m) mean, var_samp(m) v FROM c GROUP BY stratum),
h AS (SELECT *, sqrt(2 * v * ln(80) / n) + 14 * ln(80) / (3 * (n - 1)) half FROM s)
SELECT stratum, n AS clusters, round(mean, 6) AS mean, CASE WHEN n >= 2 THEN round(greatest(-1, mean - half), 6) END AS lo,
CASE WHEN n >= 2 THEN round(least(1, mean + half), 6) END AS hi FROM h""")
def AG07_AG35_cluster_means(v: View) -> DataFrame:
    items = v("trial_items").withColumn("delta", F.col("candidate") - F.col("base"))
    return trials.cluster_means(items, "delta", "cluster", "stratum", -1.0, 1.0)


@query("""WITH p AS (SELECT split, pair_id, max(task_id) task_id, max(CASE WHEN arm = 'edit' AND error_class = 'none' THEN pass::INT END)
 - max(CASE WHEN arm = 'base' AND error_class = 'none' THEN pass::INT END) o FROM trials GROUP BY ALL),
k AS (SELECT split, task_id, count(*) FILTER (o = 1) b, count(*) FILTER (o = -1) c, count(*) FILTER (o = 0) t, count(*) FILTER (o = -1) = count(*) lost FROM p GROUP BY ALL)
SELECT split, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(t)::BIGINT AS ties, count(*) FILTER (lost) AS lost_tasks FROM k GROUP BY split""")
def AG08_evidence(v: View) -> DataFrame:
    return sequential.evidence(sequential.pair_outcomes(v("trials")), ["split"])


@query("""WITH p AS (SELECT split, pair_id, max(CASE WHEN arm = 'edit' AND error_class = 'none' THEN pass::INT END)
 - max(CASE WHEN arm = 'base' AND error_class = 'none' THEN pass::INT END) o FROM trials GROUP BY ALL),
k AS (SELECT split, count(*) FILTER (o = 1) b, count(*) FILTER (o = -1) c FROM p GROUP BY split)
SELECT split, round(CASE WHEN b + c = 0 THEN 0 ELSE lgamma(b + 1) + lgamma(c + 1) - lgamma(b + c + 2) + (b + c) * ln(2) END, 6) AS log_e FROM k""")
def AG09_log_e(v: View) -> DataFrame:
    return sequential.readings(sequential.evidence(sequential.pair_outcomes(v("trials")), ["split"])).select("split", "log_e")


@query()
def AG12_gate_readings(v: View) -> DataFrame:
    return sequential.readings(sequential.evidence(sequential.pair_outcomes(v("trials")), ["split"]))


@query()
def AG13_promote(v: View) -> DataFrame:
    return sequential.promote(AG12_gate_readings(v))


@query("""SELECT grouping(first)::BIGINT * 0 + grouping(second)::BIGINT AS pooled, second AS part, first AS row, count(*) AS n, count(*) FILTER (first = second) AS decided
FROM rater_pairs GROUP BY GROUPING SETS ((first), (second, first))""")
def AG18_coverage(v: View) -> DataFrame:
    g = ag.coverage(v("rater_pairs").select("first", "second", (F.col("first") == F.col("second")).alias("d")), "first", "second", F.col("d"))
    return g.select(F.col("second").isNull().cast("long").alias("pooled"), F.col("second").alias("part"), F.col("first").alias("row"), "n", "decided")


@query("SELECT event_type, round(list_sort(list(value))[count(value) // 2 + 1], 6) AS upper_median, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM events GROUP BY event_type")
def AG20_latency(v: View) -> DataFrame:
    return selection.upper_medians(v("events"), "event_type", "value").join(v("events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi")), "event_type")


@query("""WITH m AS (SELECT invariant, count(*) n, median(value) md, avg(value) mean, coalesce(stddev_samp(value), 0) sd FROM band_rows GROUP BY invariant),
d AS (SELECT b.invariant, median(abs(value - md)) * 1.4826 mad FROM band_rows b JOIN m ON b.invariant = m.invariant GROUP BY b.invariant)
SELECT m.invariant, n, round(md, 6) AS median, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mad, 6) AS mad FROM m JOIN d ON m.invariant = d.invariant""")
def AG21_spread(v: View) -> DataFrame:
    return verifiers.spread(v("band_rows"), "invariant")


@query("""WITH k(n, k2) AS (VALUES (5, 4.164), (6, 3.730), (7, 3.464), (8, 3.268), (9, 3.128), (10, 3.021), (11, 2.935), (12, 2.865)),
m AS (SELECT invariant, count(*) n, median(value) md, stddev_samp(value) sd, median(ci_half) ci, min(value) a, max(value) z, min(band_lo) b0, max(band_hi) b1,
  bool_and(value BETWEEN band_lo AND band_hi) inside, bool_and(value = trunc(value) AND band_lo = trunc(band_lo) AND band_hi = trunc(band_hi)) units FROM band_rows GROUP BY invariant),
t AS (SELECT m.*, k2::DOUBLE * sd tol, ci * 1.0 ci1, abs(md) * 0.02 rel, CASE WHEN invariant LIKE '%\\_us' ESCAPE '\\' THEN 9000.0 WHEN invariant LIKE '%\\_ms' ESCAPE '\\' THEN 50000.0 ELSE 0 END flo FROM m LEFT JOIN k ON m.n = k.n),
h AS (SELECT *, CASE WHEN invariant IN ('7', '14_us') THEN 'declared' WHEN inside THEN 'in-band' WHEN units THEN 'quantised' WHEN tol IS NULL THEN 'no-factor'
  WHEN greatest(tol, ci1, rel, flo) = 0 THEN 'no-width' ELSE 'derived' END why, greatest(tol, ci1, rel, flo) half FROM t),
o AS (SELECT *, CASE WHEN b0 >= 0 THEN greatest(md - half, 0) ELSE md - half END low FROM h),
r AS (SELECT *, floor(low * 10000) / 10000 lo1, ceil((md + half) * 10000) / 10000 hi1 FROM o)
SELECT invariant, n, round(md, 6) AS centre, why, round(CASE WHEN why = 'derived' THEN half END, 6) AS half_width,
CASE WHEN why = 'derived' THEN CASE half WHEN tol THEN 'k*stddev' WHEN ci1 THEN 'ci_half' WHEN rel THEN 'relative' ELSE 'floor' END END AS binding,
CASE WHEN why = 'derived' THEN CASE WHEN b0 >= 0 THEN 'zero' ELSE 'derive' END END AS lower_policy,
round(CASE why WHEN 'derived' THEN lo1 WHEN 'declared' THEN b0 WHEN 'in-band' THEN b0 END, 6) AS lo, round(CASE why WHEN 'derived' THEN hi1 WHEN 'declared' THEN b1 WHEN 'in-band' THEN b1 END, 6) AS hi,
CASE WHEN why = 'derived' THEN a >= lo1 AND z <= hi1 END AS holds_own FROM r""")
def AG23_bands(v: View) -> DataFrame:
    return verifiers.derive_bands(v("band_rows"), "invariant", ci_factor=1.0, floor_us=9000.0, floor_ms=50000.0, keep=("7", "14_us"), lower="zero")


@query("""WITH d AS (SELECT *, CASE status WHEN 'fail' THEN 'killed' WHEN 'pass' THEN 'survived' ELSE 'inconclusive' END o, kind = 'mutant' AND expect = 'equivalent' eq,
kind = 'mutant' AND expect <> 'equivalent' mu FROM doctor_runs), c AS (SELECT task, count(*) FILTER (kind = 'reference') r, count(*) FILTER (kind = 'reference' AND status = 'fail') fr,
count(*) FILTER (kind = 'reference' AND status NOT IN ('fail', 'pass')) ur, count(*) FILTER (mu AND o = 'killed') k, count(*) FILTER (mu AND o = 'survived') s, count(*) FILTER (mu AND o = 'inconclusive') i,
count(*) FILTER (eq) e, count(*) FILTER (eq AND o = 'inconclusive') ue, count(*) FILTER (mu AND origin = 'hand' AND o = 'survived') h FROM d GROUP BY task), q AS (SELECT *, k::DOUBLE / nullif(k + s, 0) kr FROM c)
SELECT task, r AS "references", fr AS failed_references, ur AS unsettled_references, k AS killed, s AS survived, i AS inconclusive, e AS equivalent, ue AS unsettled_equivalent, h AS hand_survivors,
round(kr, 6) AS kill_rate, fr = 0 AND ur < r AS meaningful, CASE WHEN fr > 0 OR h > 0 THEN 'unhealthy' WHEN ur >= r THEN 'inconclusive' WHEN kr < 0.8 THEN 'unhealthy'
WHEN kr IS NULL OR ur + i + ue > 0 THEN 'inconclusive' ELSE 'healthy' END AS verdict FROM q""")
def AG27_doctor(v: View) -> DataFrame:
    return verifiers.doctor_summary(v("doctor_runs"))


@query("""SELECT DISTINCT task, band FROM doctor_runs m WHERE kind = 'mutant' AND status = 'fail' AND band < 3
AND NOT EXISTS (SELECT 1 FROM doctor_runs r WHERE r.task = m.task AND r.band = m.band AND r.kind = 'reference' AND r.status = 'fail')""")
def AG29_beyond_reference(v: View) -> DataFrame:
    failed = F.when((F.col("status") == "fail") & (F.col("band") < 3), F.array("band")).otherwise(F.array().cast("array<int>"))
    return verifiers.beyond_reference(v("doctor_runs").withColumn("band_failed", failed))


@query("""WITH d AS (SELECT set_name, coalesce(reference, '') = '' AS none, base, candidate, CASE WHEN coalesce(reference, '') <> '' THEN candidate - base END x FROM trial_items)
SELECT set_name AS "set", count(x) AS evaluable, count(*) FILTER (none) AS no_reference, count(*) FILTER (NOT none AND x IS NULL) AS unmeasured, count(*) FILTER (x = 1 AND base = 0) AS newly_right,
count(*) FILTER (x = -1 AND base = 1) AS newly_wrong, round(avg(base) FILTER (x IS NOT NULL), 3) AS q_base, round(avg(candidate) FILTER (x IS NOT NULL), 3) AS q_new, round(coalesce(100 * avg(x), 0), 3) AS points FROM d GROUP BY set_name""")
def AG31_quality(v: View) -> DataFrame:
    return trials.quality(v("trial_items").withColumnRenamed("set_name", "set"))


@query("""WITH w AS (SELECT set_name, stratum, count(*)::DOUBLE share FROM trial_items GROUP BY ALL),
d AS (SELECT set_name, stratum, count(*) n, avg(candidate - base) m FROM trial_items WHERE candidate IS NOT NULL AND base IS NOT NULL GROUP BY ALL),
j AS (SELECT w.*, coalesce(n, 0) n, m FROM w LEFT JOIN d ON w.set_name = d.set_name AND w.stratum = d.stratum)
SELECT set_name AS "set", CASE WHEN bool_and(n >= 5) THEN round(sum(share * m) / sum(share), 6) END AS weighted, min(n) AS fewest FROM j GROUP BY set_name""")
def AG32_weighted_quality(v: View) -> DataFrame:
    items = v("trial_items").withColumnRenamed("set_name", "set")
    return trials.weighted_quality(items, items.groupBy("set", "stratum").agg(F.count("*").cast("double").alias("share")))


@query("""SELECT count(*) AS n, round(avg(base_s), 6) AS base_mean, round(avg(candidate_s), 6) AS candidate_mean, round(median(base_s), 6) AS base_median,
round(median(candidate_s), 6) AS candidate_median, round(1 - avg(candidate_s) / avg(base_s), 6) AS gain FROM trial_items""")
def AG33_speed(v: View) -> DataFrame:
    return trials.speed(v("trial_items"))


def _mined(v: View) -> DataFrame:
    c = v("candidates").withColumns({
        "task_id": F.col("task_id").cast("string"), "task_files": F.array(F.lit("a.go"), F.lit("b.go")), "instruction": F.lit("Fix the parser."), "configured": F.lit(0),
        "diff_files": F.when(F.col("status") == "ok", F.when(F.col("task_id") % 5 == 0, F.array(F.lit("a.go"), F.lit("x_test.go"))).otherwise(F.array(F.lit("a.go")))).otherwise(F.array().cast("array<string>")),
    })
    runs = c.groupBy("run_id").agg(F.min("task_files").alias("task_files"), F.min("instruction").alias("instruction"), F.max("configured").alias("configured"))
    ver = c.where("verify_status is not null").select("run_id", "proposer_id", "verify_status", "exit_code", "apply_error",
                                                      F.when(F.col("verify_status") == "fail", F.array(F.concat(F.lit("band-"), F.col("task_id")))).alias("band_failed"))
    passed = F.sort_array(F.collect_list(F.when(F.col("verify_status") == "pass", F.col("proposer_id"))))
    sel = c.groupBy("run_id").agg(passed.alias("p")).where("size(p) > 0").select(
        "run_id", F.element_at("p", 1).alias("selected"), F.transform(F.slice("p", 2, 100), lambda x: x.cast("string")).alias("also_passed"))
    cand = c.select("run_id", "proposer_id", "task_id", "status", "error", "finish_reason", "diff_files")
    return mining.joined(cand, ver, runs, sel)


# Names, categories and surfaces are written here as the reference states them, not taken from the operators.
PLAIN = " UNION ALL ".join(
    f"SELECT '{r}' AS rule, '{s}' AS slug, '{g}' AS category, '{h}' AS component, {t} AS task, {k} AS key, run_id, proposer_id, pool FROM c WHERE {w}"
    for r, s, g, h, t, k, w in (
        ("R1", "no-diff-emitted", "not-provided", "system-prompt", "NULL", "''", "status = 'no_diff'"),
        ("R2", "non-completion-response", "not-provided", "tool-description", "NULL", "''", "status = 'malformed'"),
        ("R3", "context-lines-drift", "unsafe-provided", "memory", "task_id::VARCHAR", "''", "verify_status = 'apply_failed' AND apply_error LIKE '%patch does not apply%'"),
        ("R4", "malformed-hunk", "unsafe-provided", "memory", "task_id::VARCHAR", "''", "verify_status = 'apply_failed' AND apply_error LIKE '%corrupt patch at line%'"),
        ("R5", "out-of-scope-path", "unsafe-provided", "memory", "task_id::VARCHAR", "''", "verify_status = 'apply_failed' AND apply_error LIKE '%already exists%'"),
        ("R6", "task-specific-knowledge-gap", "unsafe-provided", "memory", "task_id::VARCHAR", "''", "verify_status = 'fail' AND passed > 0 AND pool >= 2"),
        ("R7", "instruction-underspecified", "not-provided", "memory", "task_id::VARCHAR", "''", "status = 'ok' AND ok > 0 AND failed = ok AND pool >= 2"),
        ("R8", "proposer-budget-exceeded", "wrong-duration", "middleware", "NULL", "''", "status = 'timeout'"),
        ("R9", "verify-budget-exceeded", "wrong-duration", "middleware", "task_id::VARCHAR", "''", "verify_status = 'timeout'"),
        ("R10", "completion-truncated", "wrong-duration", "system-prompt", "NULL", "''", "status = 'ok' AND finish_reason = 'length'"),
        ("R11", "edits-unlisted-file", "unsafe-provided", "system-prompt", "task_id::VARCHAR", "''", "status = 'ok' AND task_id % 5 = 0"),
        ("R12", "edits-the-tests", "unsafe-provided", "system-prompt", "task_id::VARCHAR", "''", "status = 'ok' AND task_id % 5 = 0"),
        ("R13", "single-proposer-dependence", "not-provided", "subagent-config", "task_id::VARCHAR", "''", "verify_status = 'pass' AND passed = 1 AND pool >= 2"),
        ("R14", "persistent-band-breach", "wrong-timing", "middleware", "task_id::VARCHAR", "concat('band-', task_id)", "verify_status = 'fail'"),
        ("R16", "request-rejected-by-server", "unsafe-provided", "system-prompt", "NULL", "CASE WHEN error LIKE '%429%' THEN 'rate-limited' ELSE 'context-length' END", "error LIKE '%429%' OR error LIKE '%400%'"),
    )
)


@query(f"""WITH c AS (SELECT *, count(*) OVER w pool, count(*) FILTER (verify_status = 'pass') OVER w passed, count(*) FILTER (status = 'ok') OVER w ok,
count(*) FILTER (status = 'ok' AND verify_status = 'fail') OVER w failed FROM candidates WINDOW w AS (PARTITION BY run_id)), o AS ({PLAIN})
SELECT rule, slug, category, component, task, key, count(DISTINCT run_id) AS runs, count(DISTINCT proposer_id) AS proposers, count(*) AS n, min(pool) AS min_pool FROM o GROUP BY ALL
HAVING count(DISTINCT run_id) >= 2""")
def AG37_mined_patterns(v: View) -> DataFrame:
    return mining.buckets(mining.observations(_mined(v)))


@query("""WITH e AS (SELECT trim(regexp_replace(error, '\\s+', ' ', 'g')) t FROM candidates WHERE status = 'http_error' AND error NOT LIKE '%429%' AND error NOT LIKE '%400%'),
l AS (SELECT count(*) n, list_sort(list(DISTINCT t)) u FROM e) SELECT n, array_to_string(u[1:8], '; ') || CASE WHEN len(u) > 8 THEN '; and ' || (len(u) - 8) || ' more' ELSE '' END AS texts FROM l""")
def AG38_not_mined(v: View) -> DataFrame:
    return mining.not_mined(_mined(v))


TALLY = """t AS (SELECT grp, least(first, second) low, greatest(first, second) high, CASE winner WHEN 'first' THEN first WHEN 'second' THEN second END won, labeler FROM votes),
y AS (SELECT grp, low, high, count(*) FILTER (won = low) low_wins, count(*) FILTER (won = high) high_wins, count(*) FILTER (won IS NULL) ties, count(DISTINCT labeler) labelers FROM t GROUP BY ALL),
m AS (SELECT *, CASE WHEN low_wins > high_wins AND low_wins >= ties THEN low WHEN high_wins > low_wins AND high_wins >= ties THEN high ELSE 'tie' END majority FROM y)"""


@query(f"WITH {TALLY} SELECT * FROM m")
def AG39_tallies(v: View) -> DataFrame:
    return pairwise.tallies(v("votes"))


TRIPLE = f"""WITH {TALLY}, s AS (SELECT DISTINCT grp, low s FROM m UNION SELECT DISTINCT grp, high FROM m),
x AS (SELECT a.grp, a.s s1, b.s s2, c.s s3, p.majority m12, q.majority m13, r.majority m23,
  p.low_wins + p.high_wins + p.ties + q.low_wins + q.high_wins + q.ties + r.low_wins + r.high_wins + r.ties n
  FROM s a JOIN s b ON a.grp = b.grp AND a.s < b.s JOIN s c ON a.grp = c.grp AND b.s < c.s LEFT JOIN m p ON p.grp = a.grp AND p.low = a.s AND p.high = b.s
  LEFT JOIN m q ON q.grp = a.grp AND q.low = a.s AND q.high = c.s LEFT JOIN m r ON r.grp = a.grp AND r.low = b.s AND r.high = c.s),
z AS (SELECT *, CASE WHEN m12 IS NULL OR m13 IS NULL OR m23 IS NULL THEN 'incomplete' WHEN n < 3 THEN 'thin'
  WHEN (m12 = s1 AND m23 = s2 AND m13 = s3) OR (m12 = s2 AND m23 = s3 AND m13 = s1) THEN 'cyclic' ELSE 'eligible' END state,
  m12 IN (s1, 'tie') AND m13 IN (s1, 'tie') u1, m12 IN (s2, 'tie') AND m23 IN (s2, 'tie') u2, m13 IN (s3, 'tie') AND m23 IN (s3, 'tie') u3 FROM x)"""


@query(f"""{TRIPLE} SELECT grp, s1, s2, s3, state, CASE WHEN state = 'eligible' THEN CASE WHEN u1::INT + u2::INT + u3::INT <> 1 THEN 'tie'
WHEN u1 THEN s1 WHEN u2 THEN s2 ELSE s3 END END AS gold FROM z""")
def AG41_triples(v: View) -> DataFrame:
    return pairwise.triples(pairwise.tallies(v("votes")))


@query(f"""{TRIPLE} SELECT count(*) AS triples, count(*) FILTER (state = 'incomplete') AS incomplete, count(*) FILTER (state = 'thin') AS thin,
count(*) FILTER (state = 'cyclic') AS cyclic, count(*) FILTER (state = 'eligible') AS eligible,
round(coalesce(count(*) FILTER (state = 'cyclic')::DOUBLE / nullif(count(*) FILTER (state <> 'incomplete'), 0), 0), 6) AS cycle_rate FROM z""")
def AG43_derivation_stats(v: View) -> DataFrame:
    return pairwise.derivation_stats(pairwise.triples(pairwise.tallies(v("votes"))))


@query()
def AG42_bradley_terry(v: View) -> DataFrame:
    return pairwise.bradley_terry(pairwise.tallies(v("votes")))


@query("""WITH h AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url, sha256(coalesce(html, '')) s FROM pages)
SELECT host, sha256(string_agg(url || chr(10) || s || chr(10), '' ORDER BY url || chr(10) || s || chr(10))) AS digest, count(*) AS files FROM h GROUP BY host""")
def AG45_tree_digest(v: View) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")
    return v("pages").groupBy(host).agg(text.tree_digest(F.col("url"), F.sha2(F.coalesce("html", F.lit("")), 256)).alias("digest"), F.count("*").alias("files"))


@query("""WITH a AS (SELECT item, count(DISTINCT annotator) n, count(DISTINCT value) k, min(value) v FROM annotations GROUP BY item)
SELECT a.item, CASE WHEN n >= 2 AND k = 1 THEN v ELSE d.value END AS resolved, CASE WHEN n >= 2 AND k = 1 THEN 'agreed' WHEN d.value IS NOT NULL THEN 'adjudicated' ELSE 'unresolved' END AS how
FROM a LEFT JOIN adjudications d ON a.item = d.item""")
def AG48_resolved_labels(v: View) -> DataFrame:
    return trials.resolve_labels(v("annotations"), v("adjudications"))


EACH = ", ".join(f"count(*) FILTER (first = '{k}') f{i}, count(*) FILTER (second = '{k}') s{i}" for i, k in enumerate(KINDS))
LESS = " + ".join(f"(f{i} - (first = '{k}')::INT) * (s{i} - (second = '{k}')::INT)" for i, k in enumerate(KINDS))
CHANCE = " + ".join(f"f{i} * s{i}" for i in range(len(KINDS)))


@query(f"""WITH g AS MATERIALIZED (SELECT rater, item, arg_min(choice, seq) AS choice FROM ratings GROUP BY ALL),
top AS MATERIALIZED (SELECT a.rater AS rater_a, b.rater AS rater_b FROM g a JOIN g b ON a.item = b.item AND a.rater < b.rater GROUP BY ALL ORDER BY count(*) DESC, rater_a, rater_b LIMIT 1),
p AS MATERIALIZED (SELECT a.item, a.choice AS first, b.choice AS second FROM top JOIN g a ON a.rater = rater_a JOIN g b ON b.rater = rater_b AND a.item = b.item),
t AS (SELECT count(*) n, count(*) FILTER (first = second) same, {EACH} FROM p),
r AS (SELECT (same - (first = second)::INT)::DOUBLE / (n - 1) po, ({LESS})::DOUBLE / ((n - 1) * (n - 1)) pe FROM p, t), v AS (SELECT var_pop((po - pe) / (1 - pe)) v FROM r),
k AS (SELECT n, same::DOUBLE / n po, ({CHANCE})::DOUBLE / (n * n) pe FROM t), h AS (SELECT k.*, (po - pe) / (1 - pe) kap, {Z} * sqrt(v * (n - 1)) half FROM k, v)
SELECT rater_a, rater_b, n::BIGINT AS n, n::BIGINT AS clusters, round(po, 6) AS p_o, round(pe, 6) AS p_e, round(kap, 6) AS kappa, round((5 * po - 1) / 4, 6) AS pabak,
round(greatest(-1.0, kap - half), 6) AS kappa_lo, round(least(1.0, kap + half), 6) AS kappa_hi FROM h, top""")
def JN06_most_shared_pair(v: View) -> DataFrame:
    return ag.human_agreement(v("ratings"), "rater", "item", "choice", "seq", KINDS)


OUTCOME = """p AS (SELECT split, pair_id, max(CASE WHEN arm = 'edit' AND error_class = 'none' THEN pass::INT END)
 - max(CASE WHEN arm = 'base' AND error_class = 'none' THEN pass::INT END) outcome FROM trials GROUP BY ALL)"""


@query(f"""WITH {OUTCOME} SELECT split, pair_id, outcome, count(*) FILTER (outcome = 1) OVER w AS cum_b, count(*) FILTER (outcome = -1) OVER w AS cum_c,
count(*) FILTER (outcome = 0) OVER w AS cum_ties, count(*) OVER w AS n FROM p WHERE outcome IS NOT NULL WINDOW w AS (PARTITION BY split ORDER BY pair_id)""")
def WN01_running_evidence(v: View) -> DataFrame:
    return sequential.running(sequential.pair_outcomes(v("trials")))


@query(f"""WITH {OUTCOME}, r AS (SELECT split, count(*) FILTER (outcome = 1) OVER w b, count(*) FILTER (outcome = -1) OVER w c, count(*) OVER w n, count(outcome) OVER w a, count(*) OVER (PARTITION BY split) pairs
FROM p WINDOW w AS (PARTITION BY split ORDER BY pair_id)),
e AS (SELECT *, lgamma(b + 1) + lgamma(c + 1) - lgamma(b + c + 2) + (b + c) * ln(2) e FROM r), d AS (SELECT *, (n % 10 = 0 OR n = pairs) AND b <> c AND e >= CASE WHEN b > c THEN ln(40) ELSE ln(20) END d FROM e)
SELECT split, min(n) FILTER (d) AS stop_n, arg_min(a, n) FILTER (d) AS stop_answered, max(pairs) AS pairs FROM d GROUP BY split""")
def WN03_early_stop(v: View) -> DataFrame:
    return sequential.stop_at(sequential.pair_outcomes(v("trials")))


@query(f"""WITH {OUTCOME}, i AS (SELECT *, count(outcome) OVER (PARTITION BY split ORDER BY pair_id) k FROM p), r AS (SELECT split, k, count(*) n FROM i WHERE outcome IS NULL GROUP BY ALL)
SELECT split, max(n) AS longest, max(n) >= 5 AS aborts FROM r GROUP BY split""")
def WN04_unanswered_runs(v: View) -> DataFrame:
    return sequential.unanswered_runs(sequential.pair_outcomes(v("trials")))


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) k, count(*) OVER () n FROM part)
SELECT p_partkey, CASE WHEN k <= round(n * 0.4) THEN 'clear' WHEN k <= round(n * 0.4) + round(n * 0.3) THEN 'close' ELSE 'rest' END AS stratum FROM r""")
def WN05_strata(v: View) -> DataFrame:
    return pairwise.stratify(v("part"), "p_size", ["p_partkey"], SHARES).select("p_partkey", "stratum")


@query("""WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('1|' || p_partkey)) k FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13'))
SELECT p_brand, p_partkey FROM r WHERE k <= CASE p_brand WHEN 'Brand#11' THEN 5 WHEN 'Brand#12' THEN 7 ELSE 3 END""")
def WN06_sample(v: View) -> DataFrame:
    quotas = {"Brand#11": 5, "Brand#12": 7, "Brand#13": 3}
    return pairwise.sample(v("part").where(F.col("p_brand").isin(*quotas)), "p_brand", "p_partkey", quotas).select("p_brand", "p_partkey")


@query("""WITH w AS (SELECT user_id, first_value(event_type) OVER z AS first, event_type later, row_number() OVER z rn FROM events WINDOW z AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, rn::INT AS rn, first, later FROM w WHERE rn > 1""")
def WN08_repeats(v: View) -> DataFrame:
    return ag.repeats(v("events"), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH r AS (SELECT set_name, item, row_number() OVER (PARTITION BY set_name ORDER BY item) i FROM trial_items WHERE set_name IN ('D', 'R')),
n AS (SELECT count(*) FILTER (set_name = 'D') d, count(*) FILTER (set_name = 'R') r FROM r)
SELECT set_name AS "set", item, i::INT AS i, CASE WHEN set_name = 'D' THEN i ELSE (2 * i * d + r + 1) // (2 * (r + 1)) END AS after, (set_name = 'R')::INT AS second FROM r, n""")
def WN09_interleave(v: View) -> DataFrame:
    return trials.interleave(v("trial_items").withColumnRenamed("set_name", "set"), "item")


@query("""WITH b AS (SELECT set_name, item, (row_number() OVER (PARTITION BY set_name ORDER BY item) - 1) // 4 AS block FROM trial_items),
p AS (SELECT set_name, item, block, t.turn, CASE WHEN (block + t.turn) % 2 = 0 THEN 'base' ELSE 'candidate' END AS condition FROM b, (VALUES (0), (1)) t(turn)),
l AS (SELECT *, lag(condition) OVER (PARTITION BY set_name ORDER BY block, turn, item) q FROM p)
SELECT set_name AS "set", count(*) FILTER (q IS NOT NULL AND q <> condition) AS switches FROM l GROUP BY set_name""")
def WN10_WN11_switches(v: View) -> DataFrame:
    plan = trials.blocks(v("trial_items").withColumnRenamed("set_name", "set"), "item", 4)
    return trials.switches(plan, "item")


@query("""WITH t AS (SELECT DISTINCT 'all' AS split, p_brand FROM part), r AS (SELECT split, p_brand, repeat, row_number() OVER (PARTITION BY split ORDER BY repeat, p_brand) place
FROM t, (SELECT unnest(range(0, 3)) AS repeat) x), c AS (SELECT * FROM r WHERE place <= 60)
SELECT p_brand, split, repeat::INT AS repeat, place::INT AS place, count(*) OVER (PARTITION BY split, p_brand) AS task_repeats FROM c""")
def WN12_schedule(v: View) -> DataFrame:
    return trials.schedule(v("part").select("p_brand").distinct().withColumn("split", F.lit("all")), "p_brand", 3, 60)


@query("""WITH c AS (SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn) t FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(t) AS digest FROM c""")
def SC14_flattened(v: View) -> DataFrame:
    turns = F.collect_list(F.struct("turn", "role", "text"))
    return v("conversations").groupBy("conv_id").agg(text.flatten_conversation(turns).alias("t")).select("conv_id", F.sha2("t", 256).alias("digest"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def SC01_slugs(v: View) -> DataFrame:
    return v("part").select("p_partkey", text.slugify(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


def _graph(v: View, nodes: str = "nodes") -> tuple[DataFrame, DataFrame]:
    return v(nodes).withColumn("touches", F.when(F.col("touched").isNotNull(), F.array("touched"))).withColumn("in_force_until", F.col("in_force_until").cast("date")), v("edges")


FORCE = f"(in_force_from <= DATE '{DAY}' AND (in_force_until IS NULL OR DATE '{DAY}' < in_force_until))"
GRAPH = f"""WITH g AS (SELECT *, {FORCE} f FROM nodes), e AS (SELECT * FROM edges),
i AS (SELECT dst id, count(*) FILTER (name = 'enforces') enf, count(*) FILTER (name = 'deviates-from') dev, count(*) FILTER (name = 'supersedes') sup, count(*) FILTER (name = 'validates') val FROM e GROUP BY dst),
o AS (SELECT src id, count(*) FILTER (name = 'enforces') oenf, count(*) FILTER (name = 'counterexample') cex, count(*) FILTER (name = 'interop') itp, count(*) FILTER (name = 'predicts') prd, count(*) FILTER (name = 'about') abt FROM e GROUP BY src),
via AS (SELECT src id, bool_or(name = 'premise' AND NOT f) stale, bool_or(name = 'interop' AND modality IS DISTINCT FROM 'MUST') weak, bool_or(name = 'predicts' AND status = 'withdrawn') wd FROM e JOIN g ON e.dst = g.id GROUP BY src),
inb AS (SELECT dst id, bool_or(name = 'supersedes' AND f AND status = 'accepted') suc, bool_or(name = 'validates' AND split = 'held-in' AND verdict IN ('improve', 'hold')) vin,
  bool_or(name = 'validates' AND split = 'held-out' AND verdict IN ('improve', 'hold')) vout, bool_or(name = 'validates' AND verdict = 'improve') imp, bool_or(name = 'predicts' AND status = 'accepted') fixd FROM e JOIN g ON e.src = g.id GROUP BY dst),
x AS (SELECT g.*, coalesce(enf, 0) enf, coalesce(dev, 0) dev, coalesce(sup, 0) sup, coalesce(val, 0) val, coalesce(oenf, 0) oenf, coalesce(cex, 0) cex, coalesce(itp, 0) itp, coalesce(prd, 0) prd, coalesce(abt, 0) abt,
  coalesce(stale, false) stale, coalesce(weak, false) weak, coalesce(wd, false) wd, coalesce(suc, false) suc, coalesce(vin, false) vin, coalesce(vout, false) vout, coalesce(imp, false) imp, coalesce(fixd, false) fixd
  FROM g LEFT JOIN i USING (id) LEFT JOIN o USING (id) LEFT JOIN via USING (id) LEFT JOIN inb USING (id))"""
RULE_SQL = {
    "orphan_must": "modality = 'MUST' AND status = 'accepted' AND enf = 0",
    "orphan_test": "kind = 'conform' AND oenf = 0",
    "stale_premise": "status = 'accepted' AND stale",
    "deviation_pressure": "status = 'accepted' AND dev >= 5",
    "no_counterexample": "kind = 'clause' AND status = 'accepted' AND cex = 0",
    "may_without_interop": "modality = 'MAY' AND status = 'accepted' AND itp = 0",
    "interop_not_must": "weak",
    "status_drift": "status <> 'superseded' AND suc",
    "pending_successor": "status = 'accepted' AND sup > 0 AND NOT suc",
    "premature_superseded": "status = 'superseded' AND NOT suc",
    "accepted_unvalidated": "kind = 'edit' AND status = 'accepted' AND NOT (vin AND vout AND imp)",
    "edit_touches_readonly": "kind = 'edit' AND (touched IS NULL OR touched IN ('verifier', 'tracer', 'model-config'))",
    "edit_without_prediction": "kind = 'edit' AND f AND prd = 0",
    "rejected_without_run": "kind = 'edit' AND status = 'rejected' AND val = 0",
    "propose_only_accepted": "kind = 'edit' AND status = 'accepted' AND component = 'tool-implementation'",
    "accepted_without_approver": "kind = 'edit' AND status = 'accepted' AND approval = 'auto' AND component IN ('system-prompt', 'tool-description', 'middleware', 'subagent-config')",
    "pattern_resolved_unfixed": "kind = 'pattern' AND status = 'resolved' AND NOT fixd",
    "predicts_withdrawn": "kind = 'edit' AND status IN ('proposed', 'accepted') AND wd",
    "edit_without_topic": "kind = 'edit' AND f AND abt = 0",
}


@query(f"{GRAPH} " + " UNION ALL ".join(f"SELECT id, '{r}' AS rule FROM x WHERE {w}" for r, w in RULE_SQL.items()))
def GR_all_findings(v: View) -> DataFrame:
    return graph.findings(*_graph(v), DAY)


def _one_rule(number: int, name: str) -> None:
    nodes = "surface_nodes" if name == "propose_only_accepted" else "nodes"  # in nodes no accepted edit has that surface

    def run(v: View) -> DataFrame:
        return graph.findings(*_graph(v, nodes), DAY, {name: graph.RULES[name]}).select("id")

    run.__name__ = f"GR{number:02d}_{name}"
    query(f"{GRAPH.replace('FROM nodes', f'FROM {nodes}')} SELECT id FROM x WHERE {RULE_SQL[name]}")(run)


for _number, _name in enumerate(RULE_SQL, 1):
    _one_rule(_number, _name)


@query(f"""{GRAPH}, p AS (SELECT id, enf > 0 enforced, suc has_inforce_successor, enf > 0 AND f AND status = 'accepted' AND coalesce(modality = 'MUST', false) AND NOT suc effective_must,
(coalesce(modality = 'SHOULD', false) OR (coalesce(modality = 'MUST', false) AND enf = 0)) AND status = 'accepted' AND f AND NOT suc effective_should, vin validated_in, vout validated_out, imp improved,
kind, status, modality, f, suc FROM x)
SELECT id, enforced, has_inforce_successor, effective_must, effective_should, validated_in, validated_out, improved, effective_must OR effective_should
OR (kind = 'calibration' AND f AND NOT suc) OR (coalesce(modality = 'MAY', false) AND status = 'accepted' AND f AND NOT suc) OR (kind = 'edit' AND status = 'accepted' AND f AND validated_in AND validated_out AND improved AND NOT suc) AS effective FROM p""")
def GP_projections(v: View) -> DataFrame:
    return graph.projections(*_graph(v), DAY)


@query("""SELECT src, dst, name, 'src' AS missing FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.src)
UNION ALL SELECT src, dst, name, 'dst' FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.dst)""")
def GS07_dangling(v: View) -> DataFrame:
    return graph.dangling(*_graph(v))


@query("SELECT id, 0::BIGINT AS n FROM nodes WHERE kind = 'edit' AND NOT EXISTS (SELECT 1 FROM edges WHERE src = id AND name = 'about')")
def GS06_min_outbound(v: View) -> DataFrame:
    return graph.too_few_outbound(*_graph(v), "about", "edit")


@query("SELECT src, dst FROM edges WHERE name = 'enforces' AND dst IN (SELECT dst FROM edges WHERE name = 'supersedes')")
def GS05_not_leaves(v: View) -> DataFrame:
    return graph.not_leaves(v("edges"), "enforces")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT name, src, dst FROM links WHERE name IN ('supersedes', 'excepts')), r AS (SELECT name, src, dst FROM e UNION SELECT r.name, r.src, e.dst FROM r JOIN e ON r.name = e.name AND r.dst = e.src),
c AS (SELECT a.name, a.src AS id, min(a.dst) AS component FROM r a JOIN r b ON a.name = b.name AND a.src = b.dst AND a.dst = b.src GROUP BY ALL)
SELECT name, component, id, count(*) OVER (PARTITION BY name, component) AS size FROM c""")
def GS04_cycles(v: View) -> DataFrame:
    return graph.cycles(v("links"), ["supersedes", "excepts"])


@query(f"""WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), t AS (SELECT dst id, count(*) FILTER (name = 'enforces') enf FROM edges GROUP BY dst),
v AS (SELECT dst id, bool_or(split = 'held-in' AND verdict IN ('improve', 'hold')) vin, bool_or(split = 'held-out' AND verdict IN ('improve', 'hold')) vout, bool_or(verdict = 'improve') imp
  FROM edges JOIN nodes ON src = nodes.id WHERE name = 'validates' GROUP BY dst),
s AS (SELECT n.id, kind, in_force_from a, coalesce(in_force_until, DATE '9999-12-31') b FROM nodes n LEFT JOIN t ON t.id = n.id LEFT JOIN v ON v.id = n.id WHERE kind = 'calibration' OR status = 'accepted'
  AND (modality IN ('MUST', 'SHOULD', 'MAY') OR (kind = 'edit' AND vin AND vout AND imp))),
u AS (SELECT dst id, in_force_from a, coalesce(in_force_until, DATE '9999-12-31') b FROM edges JOIN nodes ON src = nodes.id WHERE name = 'supersedes' AND status = 'accepted'),
x AS (SELECT DISTINCT s.id, day FROM s JOIN u ON s.id = u.id JOIN days ON day >= greatest(s.a, u.a) AND day < least(s.b, u.b)),
y AS (SELECT kind, day, count(*) n FROM s JOIN days ON day >= a AND day < b GROUP BY ALL), z AS (SELECT kind, day, count(*) n FROM x JOIN s ON x.id = s.id GROUP BY ALL)
SELECT day, kind, y.n - coalesce(z.n, 0) AS binding FROM y LEFT JOIN z USING (kind, day) WHERE y.n > coalesce(z.n, 0)""")
def JN11_GP05_binding_days(v: View) -> DataFrame:
    periods = graph.binding_periods(*_graph(v))
    days = v("orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return graph.on_days(periods, days).groupBy("day", "kind").agg(F.count("*").alias("binding"))


@query(f"""WITH c AS (SELECT e.dst AS topic, n.id, coalesce(modality, 'MUST_NOT') m FROM nodes n JOIN (SELECT DISTINCT src, dst FROM edges WHERE name = 'about') e ON n.id = e.src WHERE kind = 'clause' AND status = 'accepted' AND {FORCE}),
x AS (SELECT DISTINCT src, dst FROM edges WHERE name = 'interop')
SELECT a.topic, a.id, count(*) AS opposed FROM c a JOIN c b ON a.topic = b.topic AND (a.m IN ('MUST', 'SHOULD', 'MAY')) <> (b.m IN ('MUST', 'SHOULD', 'MAY'))
WHERE NOT EXISTS (SELECT 1 FROM x WHERE (src = a.id AND dst = b.id) OR (src = b.id AND dst = a.id)) GROUP BY ALL""")
def GS10_modality_conflicts(v: View) -> DataFrame:
    nodes, edges = _graph(v)
    nodes = nodes.withColumn("modality", F.coalesce("modality", F.lit("MUST_NOT"))).where(FORCE)
    return graph.modality_conflicts(nodes, edges.withColumn("name", F.when(F.col("name") == "interop", "excepts").otherwise(F.col("name"))))


@query("""SELECT id, kind, CASE WHEN modality IS NULL AND touched IS NULL THEN 'gone' ELSE 'changed' END AS fault FROM nodes WHERE kind IN ('edit', 'run', 'pattern', 'conform', 'calibration')
AND (modality IS NULL AND touched IS NULL OR component = 'skill' AND modality IS DISTINCT FROM 'MAY')""")
def GS09_history_faults(v: View) -> DataFrame:
    after = v("nodes").where("not (modality is null and touched is null)").withColumns({
        "modality": F.when(F.col("component") == "skill", "MAY").otherwise(F.col("modality")), "status": F.lit("superseded"),
    })
    return graph.history_faults(v("nodes"), after)


@query("SELECT src, dst, modality FROM edges JOIN nodes ON dst = id WHERE name = 'interop' AND modality IN ('MUST', 'MUST_NOT')")
def GS11_strict_exceptions(v: View) -> DataFrame:
    nodes, edges = _graph(v)
    return graph.strict_exceptions(nodes, edges.withColumn("name", F.when(F.col("name") == "interop", "excepts").otherwise(F.col("name"))))


@query("""SELECT id, 'id' AS field FROM nodes WHERE kind = 'run' AND NOT regexp_full_match(id, 'n[0-9]*[02468]') UNION ALL SELECT id, 'modality' FROM nodes WHERE kind = 'clause' AND modality IS NULL
UNION ALL SELECT id, 'status' FROM nodes WHERE kind = 'edit' AND status NOT IN ('proposed', 'accepted', 'superseded')""")
def GS01_GS02_field_faults(v: View) -> DataFrame:
    return graph.field_faults(v("nodes"), ids={"run": "n[0-9]*[02468]"}, required={"clause": ["modality"]}, one_of={"edit": {"status": ["proposed", "accepted", "superseded"]}})


@query("""SELECT src, dst, name, s.kind AS src_kind, d.kind AS dst_kind FROM edges JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst
WHERE (name = 'enforces' AND NOT (s.kind = 'conform' AND d.kind = 'clause')) OR (name = 'premise' AND NOT (s.kind IN ('clause', 'edit') AND d.kind = 'pattern'))""")
def GS03_endpoint_faults(v: View) -> DataFrame:
    return graph.endpoint_faults(v("nodes"), v("edges"), {"enforces": (["conform"], ["clause"]), "premise": (["clause", "edit"], ["pattern"])})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable."""
    return {name: (lambda spark, sf_dir, fn=fn: rounded(fn(lambda view: load(spark, sf_dir, view)))) for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {name: oracle(sql) for name, (_, sql) in REGISTRY.items() if sql is not None}
