"""Queries of judged runs, labels, plans, saved runs and plain record work, each with DuckDB SQL over the views."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.functions.stats import delta_cs, theta_cs
from tallyforge.operators import matching as mt
from tallyforge.operators import mining, sequential, trials, verifiers
from tallyforge.operators import validity as va
from tallyforge.plans.registry import View, query

Z = repr(NormalDist().inv_cdf(0.975))
DAY, STATUS_DAY = "1996-06-01", "1996-08-15"
POSITIONS = ["a", "b", "c"]

RULE = """CASE WHEN outcome = 'selected' THEN CASE WHEN consensus IS NOT NULL THEN 'consensus' WHEN reason LIKE 'condorcet%' THEN 'condorcet'
WHEN tie_break IS NOT NULL THEN 'tie_break' WHEN reason LIKE 'copeland%' THEN 'copeland' ELSE 'unstated' END END"""
JUDGED = f"""j AS (SELECT *, CASE WHEN outcome = 'selected' THEN candidate ELSE 'abstain' END AS category, outcome IN ('selected', 'no_candidate') AS measured, {RULE} AS rule FROM judged)"""


def _rule() -> Column:
    return va.rule(F.col("outcome"), F.col("consensus"), F.col("reason"), F.col("tie_break"))


@query(f"WITH {JUDGED} SELECT item, seed, category, measured, rule FROM j")
def PRJ01_PRJ03_judged(v: View) -> DataFrame:
    return v("judged").select("item", "seed", va.category(F.col("outcome"), F.col("candidate")).alias("category"), va.measured(F.col("outcome")).alias("measured"), _rule().alias("rule"))


LABELLED = """f AS (SELECT item, choice FROM (SELECT item, choice, row_number() OVER (PARTITION BY item ORDER BY labeler, choice) k FROM human_labels) x WHERE k = 1),
ref AS (SELECT coalesce(f.item, g.item) AS item, CASE WHEN coalesce(choice, gold) IN ('tie', 'all_bad') THEN 'abstain' ELSE coalesce(choice, gold) END AS category,
CASE WHEN choice IS NULL THEN 'gold' ELSE 'label' END AS origin FROM f FULL JOIN gold g ON f.item = g.item)"""


@query(f"WITH {LABELLED} SELECT item, category, origin FROM ref")
def PRJ04_JN04_WN07_references(v: View) -> DataFrame:
    return va.references(v("human_labels"), v("gold"))


@query("SELECT item, coalesce(task_stratum, margin_stratum, 'unbanded') AS stratum FROM gold")
def PRJ05_strata(v: View) -> DataFrame:
    return v("gold").select("item", F.coalesce("task_stratum", "margin_stratum", F.lit("unbanded")).alias("stratum"))


CALLS = """c AS (SELECT *, choice IN ('first', 'second') AS decided, choice = 'first' AS chose_first, CASE choice WHEN 'first' THEN first WHEN 'second' THEN second ELSE 'abstain' END AS side FROM orders_judged)"""
SWAPS = f"""{CALLS}, s AS (SELECT item, pair_id, max(CASE WHEN ord = 1 THEN side END) s1, max(CASE WHEN ord = 2 THEN side END) s2, bool_and(decided) d FROM c GROUP BY ALL HAVING count(*) = 2 AND count(DISTINCT ord) = 2)"""


@query(f"WITH {CALLS} SELECT item, pair_id, ord, decided, chose_first, side FROM c")
def PRJ07_calls(v: View) -> DataFrame:
    return va.calls(v("orders_judged")).select("item", "pair_id", "ord", "decided", "chose_first", "side")


SCORED = f"""WITH {JUDGED}, {LABELLED}, r AS (SELECT CASE seed WHEN 0 THEN 'base' ELSE 'candidate' END AS side, outcome, consensus,
coalesce('consensus/' || consensus, 'tie_break/' || tie_break, rule, CASE WHEN measured THEN 'judge' ELSE 'unmeasured' END) AS route,
CASE WHEN outcome = 'no_candidate' THEN CASE WHEN reason = 'invalid_output' THEN NULL ELSE 0 END WHEN outcome = 'selected' THEN CASE WHEN ref.category = 'abstain' THEN 0 WHEN j.candidate = ref.category THEN 1 ELSE 0 END END AS score
FROM j JOIN ref ON j.item = ref.item WHERE seed < 2)"""


@query(f"""{SCORED} SELECT side, route, count(*) AS items, count(*) FILTER (score IS NULL) AS unmeasured, count(*) FILTER (outcome = 'selected' AND score IS NOT NULL) AS selected,
count(*) FILTER (score = 1) AS correct, count(*) FILTER (consensus IS NOT NULL AND score = 0) AS wrong_consensus FROM r GROUP BY ALL""")
def PRJ08_PRJ10_AG36_routes(v: View) -> DataFrame:
    j = v("judged").where("seed < 2").join(va.references(v("human_labels"), v("gold")), "item")
    bad, good = F.col("category") == "abstain", F.array("category")
    score = va.assessment_score(F.col("outcome"), F.col("reason"), F.col("candidate"), bad, good, POSITIONS)
    how = va.route(F.col("consensus"), F.col("tie_break"), _rule(), va.measured(F.col("outcome")))
    side = F.when(F.col("seed") == 0, "base").otherwise("candidate")
    return va.routes(j.select(side.alias("side"), how.alias("route"), "outcome", "consensus", score.alias("score")))


@query("""SELECT j.item, seed, CASE outcome WHEN 'selected' THEN (candidate = gold)::INT WHEN 'no_candidate' THEN 0 END AS score FROM judged j JOIN gold g ON j.item = g.item""")
def PRJ09_scores(v: View) -> DataFrame:
    return v("judged").join(v("gold"), "item").select("item", "seed", va.trial_score(F.col("outcome"), F.col("candidate"), F.col("gold")).alias("score"))


@query("""SELECT task, CASE status WHEN 'fail' THEN 'killed' WHEN 'pass' THEN 'survived' ELSE 'inconclusive' END AS outcome, count(*) AS n FROM doctor_runs WHERE kind = 'mutant' GROUP BY ALL""")
def PRJ11_mutant_outcomes(v: View) -> DataFrame:
    return v("doctor_runs").where("kind = 'mutant'").groupBy("task", verifiers.outcome(F.col("status")).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT split, arm, error_class = 'none' AS answered, count(*) AS n FROM trials GROUP BY ALL")
def PRJ12_answered(v: View) -> DataFrame:
    return v("trials").groupBy("split", "arm", (F.col("error_class") == "none").alias("answered")).agg(F.count("*").alias("n"))


@query("SELECT item, set_name FROM trial_items WHERE set_name IN ('D', 'H')")
def PRJ13_only(v: View) -> DataFrame:
    return mt.only(v("trial_items"), "set_name", ["D", "H"]).select("item", "set_name")


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+/?', '') AS path FROM pages)
SELECT page_id, CASE WHEN path LIKE '/%' OR contains(path, '\\') OR regexp_matches(path, '(^|/)(\\.{0,2})(/|$)') THEN 'refused'
WHEN path = 'system-prompt.md' THEN 'system-prompt' WHEN regexp_matches(path, '^memory/[A-Za-z0-9][A-Za-z0-9._-]*\\.md$') THEN 'memory'
WHEN regexp_matches(path, '^skills/[a-z0-9][a-z0-9._-]{0,63}/SKILL\\.md$') THEN 'skill' ELSE 'refused' END AS component FROM p""")
def PRJ14_components(v: View) -> DataFrame:
    return v("pages").select("page_id", text.component(F.regexp_replace("url", "^https?://[^/]+/?", "")).alias("component"))


@query("SELECT set_name, item FROM (SELECT set_name, item, row_number() OVER (PARTITION BY set_name ORDER BY item) k FROM trial_items) x WHERE k <= 12")
def PRJ15_OR02_take(v: View) -> DataFrame:
    return va.take(v("trial_items"), "set_name", "item", 12).select("set_name", "item")


@query("""WITH p AS (SELECT DISTINCT item FROM human_labels), s AS (SELECT item, max(CASE WHEN seed = 0 THEN outcome END) b, max(CASE WHEN seed = 1 THEN outcome END) c FROM judged GROUP BY item)
SELECT p.item, b AS base, c AS candidate FROM p LEFT JOIN s ON p.item = s.item""")
def JN03_planned(v: View) -> DataFrame:
    steps = v("judged").withColumn("condition", F.when(F.col("seed") == 0, "base").when(F.col("seed") == 1, "candidate"))
    return mt.planned(v("human_labels").select("item").distinct(), steps, "item", "condition", "outcome", ("base", "candidate"))


@query("""WITH h AS (SELECT item, count(*) n FROM gold GROUP BY item), l AS (SELECT item, count(*) n FROM human_labels GROUP BY item)
SELECT * FROM (SELECT coalesce(h.item, l.item) AS item, CASE WHEN h.item IS NULL THEN 'unknown' WHEN l.item IS NULL THEN 'omitted' WHEN l.n > 1 THEN 'duplicate' END AS fault
FROM h FULL JOIN l ON h.item = l.item) x WHERE fault IS NOT NULL""")
def JN05_label_faults(v: View) -> DataFrame:
    return mt.label_faults(v("gold"), v("human_labels"), "item")


@query(f"WITH {JUDGED} SELECT item, seed, outcome FROM j WHERE seed = 2 AND EXISTS (SELECT 1 FROM j k WHERE k.item = j.item AND k.seed = 0 AND k.measured) AND EXISTS (SELECT 1 FROM j k WHERE k.item = j.item AND k.seed = 1 AND k.measured)")
def JN09_both_measured(v: View) -> DataFrame:
    j = v("judged")
    both = j.where("seed < 2").where(va.measured(F.col("outcome"))).groupBy("item").agg(F.countDistinct("seed").alias("n")).where("n = 2")
    return j.where("seed = 2").join(both, "item", "left_semi").select("item", "seed", "outcome")


@query("SELECT item FROM gold WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.item = gold.item)")
def JN10_unreached(v: View) -> DataFrame:
    return v("gold").select("item").join(v("judged"), "item", "left_anti")


@query(f"SELECT id, kind, status FROM nodes WHERE in_force_from <= DATE '{DAY}' AND (in_force_until IS NULL OR DATE '{DAY}' < in_force_until)")
def JN11_in_force(v: View) -> DataFrame:
    return mt.in_force(v("nodes"), DAY).select("id", "kind", "status")


@query("""WITH p AS (SELECT o_orderkey AS pair_id, o_custkey, CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS day FROM orders), s AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS version FROM orders GROUP BY ALL)
SELECT p.pair_id, s.version FROM p ASOF LEFT JOIN s ON p.o_custkey = s.o_custkey AND p.day >= s.o_orderdate""")
def JN11_as_of(v: View) -> DataFrame:
    orders = v("orders")
    events = orders.select(F.col("o_orderkey").alias("pair_id"), "o_custkey", F.date_add(F.col("o_orderdate").cast("date"), 30).cast("timestamp").alias("day"))
    versions = orders.groupBy("o_custkey", F.col("o_orderdate").cast("timestamp").alias("since")).agg(F.max("o_orderkey").alias("version"))
    return mt.as_of(events, versions, "o_custkey", "day", "since").select("pair_id", "version")


@query(f"""WITH p AS (SELECT *, datediff('day', window_to, DATE '{STATUS_DAY}') AS age FROM calibrations WHERE window_to <= DATE '{STATUS_DAY}'),
l AS (SELECT id, age FROM p WHERE human_kappa IS NOT NULL ORDER BY age, id LIMIT 1),
b AS (SELECT count(*) FILTER (age <= 30) n, count(*) FILTER (age <= 30 AND human_kappa IS NOT NULL) c, count(*) FILTER (age <= 30 AND verdict = 'no') r FROM p)
SELECT n AS binding, c AS binding_compared, r AS binding_refused, id AS last_human, age AS days_since, id IS NULL AS never_compared, coalesce(age > 30, false) AS stale, n = 0 AS nothing_binds,
n > 0 AND c = 0 AS only_self_consistent FROM b LEFT JOIN l ON true""")
def JN12_AG49_standing(v: View) -> DataFrame:
    return va.standing(v("calibrations"), STATUS_DAY)


@query("SELECT DISTINCT src, dst, kind, status FROM edges JOIN nodes ON dst = id WHERE name = 'premise'")
def JN13_neighbours(v: View) -> DataFrame:
    return mt.neighbours(v("nodes"), v("edges"), "premise", ["kind", "status"])


@query("""SELECT CASE WHEN a.item IS NULL THEN 'gone' WHEN r.item IS NULL THEN 'new' WHEN r.outcome IS NOT DISTINCT FROM a.outcome AND r.candidate IS NOT DISTINCT FROM a.candidate THEN 'same' ELSE 'changed' END AS state,
count(*) AS n FROM judged r FULL JOIN judged_again a ON r.item = a.item AND r.seed = a.seed GROUP BY ALL""")
def JN14_rescored(v: View) -> DataFrame:
    return va.rescored(v("judged"), v("judged_again"))


@query("""WITH d AS (SELECT w.run, s.run IS NOT NULL AS saved, list_filter([CASE WHEN w.model IS DISTINCT FROM s.model THEN 'model' END, CASE WHEN w.suite IS DISTINCT FROM s.suite THEN 'suite' END,
CASE WHEN w.seeds IS DISTINCT FROM s.seeds THEN 'seeds' END], lambda x: x IS NOT NULL) AS u FROM wanted_runs w LEFT JOIN saved_runs s ON w.run = s.run)
SELECT run, saved AND len(u) = 0 AS reused, CASE WHEN saved THEN u[1] END AS first_mismatch, CASE WHEN saved THEN array_to_string(u, ',') END AS mismatches FROM d""")
def JN15_AG46_reuse(v: View) -> DataFrame:
    return mt.reuse(v("wanted_runs"), v("saved_runs"), "run", ["model", "suite", "seeds"])


@query(f"""SELECT stratum, count(base) AS n, round(avg(base), 6) AS rate, round({Z} * sqrt(avg(base) * (1 - avg(base)) / count(base)), 6) AS half FROM trial_items GROUP BY stratum""")
def AG06_half_widths(v: View) -> DataFrame:
    g = v("trial_items").groupBy("stratum").agg(F.count("base").alias("n"), F.avg("base").alias("rate"))
    return g.withColumn("half", va.half_width(F.col("rate"), F.col("n")))


@query()
def AG10_theta_sequences(v: View) -> DataFrame:
    ev = sequential.evidence(sequential.pair_outcomes(v("trials")), ["split"])
    return ev.select("split", "b", "c", theta_cs(F.col("b"), F.col("c")).alias("t")).select("split", "b", "c", "t.lo", "t.hi")


@query()
def AG11_delta_sequences(v: View) -> DataFrame:
    ev = sequential.evidence(sequential.pair_outcomes(v("trials")), ["split"])
    return ev.select("split", delta_cs(F.col("b"), F.col("c"), F.col("b") + F.col("c") + F.col("ties")).alias("d")).select("split", "d.lo", "d.hi")


@query(f"""WITH {JUDGED}, {LABELLED}, x AS (SELECT seed, j.category AS said, ref.category AS want FROM j JOIN ref ON j.item = ref.item WHERE measured)
SELECT seed, said, want, count(*) AS n FROM x GROUP BY ALL""")
def AG14_validity_tables(v: View) -> DataFrame:
    j = v("judged").where(va.measured(F.col("outcome"))).select("item", "seed", va.category(F.col("outcome"), F.col("candidate")).alias("said"))
    want = va.references(v("human_labels"), v("gold")).select("item", F.col("category").alias("want"))
    return j.join(want, "item").groupBy("seed", "said", "want").agg(F.count("*").alias("n"))


# A consensus settles a run without a call; else three pairs are judged in both orders.
def _calibration_pairs(v: View) -> DataFrame:
    called = F.when(F.col("consensus").isNull(), 6).otherwise(0)
    runs = v("judged").select("item", "seed", va.category(F.col("outcome"), F.col("candidate")).alias("category"), va.measured(F.col("outcome")).alias("measured"), called.alias("calls"))
    return va.calibration_pairs(runs, v("human_labels"), v("gold"), va.calls(v("orders_judged")))


PAIRS = f"""{JUDGED}, {SWAPS}, {LABELLED.replace("ref AS", "ref0 AS")}, r1 AS (SELECT item, min(seed) seed FROM j GROUP BY item),
one AS (SELECT j.item, j.seed, category, consensus IS NULL AS called FROM j JOIN r1 ON j.item = r1.item AND j.seed = r1.seed WHERE measured),
fold AS (SELECT one.item, category AS answer, called, CASE WHEN f.choice IN ('tie', 'all_bad') THEN 'abstain' ELSE f.choice END AS label,
 CASE WHEN g.gold IN ('tie', 'all_bad') THEN 'abstain' ELSE g.gold END AS gold FROM one LEFT JOIN f ON f.item = one.item LEFT JOIN gold g ON g.item = one.item),
people AS (SELECT 'gold' AS measure, item, answer, gold AS other FROM fold UNION ALL SELECT 'labels', item, answer, label FROM fold
 UNION ALL SELECT 'human', item, answer, coalesce(label, gold) FROM fold UNION ALL SELECT 'human_judge_decided', item, answer, coalesce(label, gold) FROM fold WHERE called),
pairs AS (SELECT 'swap' AS measure, 'abstain-as-category' AS handling, item, s1 AS answer, s2 AS other FROM s
 UNION ALL SELECT 'rerun', 'abstain-as-category', j.item, one.category, j.category FROM one JOIN j ON j.item = one.item AND j.seed > one.seed WHERE measured
 UNION ALL SELECT measure, 'abstain-as-category', item, answer, other FROM people WHERE other IS NOT NULL
 UNION ALL SELECT measure, 'decided-only', item, answer, other FROM people WHERE other <> 'abstain' AND answer <> 'abstain')"""
_EXPECTED = " + ".join(f"(count(*) FILTER (answer = '{x}'))::DOUBLE * count(*) FILTER (other = '{x}')" for x in (*POSITIONS, va.ABSTAIN))
_LEFT = " + ".join(f"((t.f{i} - c.f{i}) * (t.s{i} - c.s{i}))::DOUBLE" for i in range(4))
_SIDES = ", ".join(f"count(*) FILTER (answer = '{x}') f{i}, count(*) FILTER (other = '{x}') s{i}" for i, x in enumerate((*POSITIONS, va.ABSTAIN)))
_TOTALS = ", ".join(f"sum({side}{i}) {side}{i}" for side in "fs" for i in range(4))


@query(f"""WITH {PAIRS}, by_item AS (SELECT measure, handling, item, count(*) n, count(*) FILTER (answer = other) same, {_SIDES} FROM pairs GROUP BY ALL),
t AS (SELECT measure, handling, sum(n) n, sum(same) same, {_TOTALS}, count(*) g FROM by_item GROUP BY ALL),
k AS (SELECT measure, handling, count(*)::BIGINT n, avg((answer = other)::INT) po, ({_EXPECTED}) / (count(*)::DOUBLE * count(*)) pe FROM pairs GROUP BY ALL),
d AS (SELECT t.measure, t.handling, t.g, (t.same - c.same)::DOUBLE / nullif(t.n - c.n, 0) po, ({_LEFT}) / nullif((t.n - c.n)::DOUBLE * (t.n - c.n), 0) pe FROM by_item c JOIN t ON c.measure = t.measure AND c.handling = t.handling),
e AS (SELECT measure, handling, max(g) g, var_pop(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END) v, count(CASE WHEN pe < 1 THEN 1 END) ok FROM d GROUP BY ALL),
o AS (SELECT k.*, g, CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END kappa, CASE WHEN g >= 2 AND ok = g THEN {Z} * sqrt(v * (g - 1)) END half FROM k JOIN e ON k.measure = e.measure AND k.handling = e.handling)
SELECT measure, handling, n, g AS clusters, round(po, 6) AS p_o, round(pe, 6) AS p_e, round(kappa, 6) AS kappa,
CASE WHEN half IS NOT NULL THEN round(greatest(-1, kappa - half), 6) END AS kappa_lo, CASE WHEN half IS NOT NULL THEN round(least(1, kappa + half), 6) END AS kappa_hi,
CASE WHEN measure = 'human' AND handling = 'abstain-as-category' THEN CASE WHEN kappa IS NULL THEN 'unmeasured' WHEN round(kappa, 3) >= 0.667 THEN 'yes' ELSE 'no' END END AS verdict FROM o""")
def AG14_calibration(v: View) -> DataFrame:
    return va.calibration(_calibration_pairs(v), [*POSITIONS, va.ABSTAIN], F.lit(False))


@query(f"WITH {SWAPS} SELECT s1 AS first, s2 AS second, count(*) AS n FROM s GROUP BY ALL")
def AG15_swap_table(v: View) -> DataFrame:
    return va.swap_table(va.calls(v("orders_judged")))


def _clustered(source: str, hit: str) -> str:
    return f"""k AS (SELECT item, count(*) FILTER ({hit}) s, count(*) n FROM {source} GROUP BY item), t AS (SELECT sum(s) s, sum(n) n, count(*) g FROM k),
v AS (SELECT var_pop((t.s - k.s)::DOUBLE / nullif(t.n - k.n, 0)) v FROM k, t),
o AS (SELECT s::BIGINT AS successes, n::BIGINT AS trials, round(s::DOUBLE / n, 6) AS rate, round(greatest(0, s::DOUBLE / n - {Z} * sqrt(v * (g - 1))), 6) AS lo,
round(least(1, s::DOUBLE / n + {Z} * sqrt(v * (g - 1))), 6) AS hi, round(abs(s::DOUBLE / n - 0.5), 6) AS bias FROM t, v)"""


@query(f"WITH {SWAPS}, b AS (SELECT * FROM s WHERE d), {_clustered('b', 's1 <> s2')} SELECT successes, trials, rate, lo, hi FROM o")
def AG15_flip_rate(v: View) -> DataFrame:
    return va.flip_rate(va.calls(v("orders_judged")))


@query(f"WITH {CALLS}, b AS (SELECT * FROM c WHERE decided), {_clustered('b', 'chose_first')} SELECT successes, trials, rate, lo, hi, bias FROM o")
def AG16_position_bias(v: View) -> DataFrame:
    return va.position_bias(va.calls(v("orders_judged")))


@query(f"""WITH {CALLS}, p AS (SELECT item, pair_id, count(*) = 2 AND bool_and(decided) ok, count(*) FILTER (chose_first) f FROM c WHERE draw_reason = 'disagree' GROUP BY ALL)
SELECT count(*) AS pairs, count(*) FILTER (ok AND f = 2) AS both_first, count(*) FILTER (ok AND f = 0) AS both_second, count(*) FILTER (NOT ok OR f = 1) AS other FROM p""")
def AG17_disagreements(v: View) -> DataFrame:
    return va.disagreements(va.calls(v("orders_judged")))


@query(f"""WITH {JUDGED}, a AS (SELECT 'outcome' AS dimension, outcome AS value FROM j UNION ALL SELECT 'reason', coalesce(reason, 'unstated') FROM j WHERE outcome = 'no_candidate'
UNION ALL SELECT 'rule', rule FROM j UNION ALL SELECT 'tie_break', tie_break FROM j UNION ALL SELECT 'consensus', consensus FROM j)
SELECT dimension, value, count(*) AS n FROM a WHERE value IS NOT NULL GROUP BY ALL""")
def AG19_counters(v: View) -> DataFrame:
    return va.counters(v("judged").withColumn("rule", _rule()))


@query("""WITH c AS (SELECT task, run_id, invariant, count(*) n, min(rev) a, max(rev) z FROM band_obs GROUP BY ALL),
r AS (SELECT task, run_id, array_to_string(list_sort(list(invariant)), ',') i, count(*) FILTER (n > 1) twice, min(a) a, max(z) z FROM c GROUP BY ALL)
SELECT task, count(*) AS runs, min(a) = max(z) AS one_rev, min(i) = max(i) AS same_invariants, sum(twice)::BIGINT AS twice FROM r GROUP BY task""")
def AG24_band_faults(v: View) -> DataFrame:
    return mt.band_faults(v("band_obs"))


@query("SELECT invariant, round(3 * max(ci_half), 6) AS guide FROM band_rows GROUP BY invariant")
def AG26_ci_guide(v: View) -> DataFrame:
    return v("band_rows").groupBy("invariant").agg((3 * F.max("ci_half")).alias("guide"))


@query("""WITH s AS (SELECT *, coalesce(error, '') <> '' AS e FROM judged), c AS (SELECT seed, count(*) n, count(*) FILTER (e) e, count(*) FILTER (NOT e AND outcome = 'selected') s,
count(*) FILTER (NOT e AND outcome = 'no_candidate') k, avg(wall_seconds) w, median(wall_seconds) m, sum(latency_ms) l, count(nullif(consensus, '')) u FROM s GROUP BY seed)
SELECT seed, n AS steps, s AS selected, k AS no_candidate, n - s - k AS unmeasured, e AS errors, round(s / n, 3) AS coverage, round(w, 3) AS mean_wall_seconds, round(m, 3) AS median_wall_seconds,
round(l / n, 3) AS recorded_latency_ms_mean, u AS consensus_steps FROM c""")
def AG30_conditions(v: View) -> DataFrame:
    return va.conditions(v("judged"), "seed")


@query("""SELECT seed, CASE WHEN coalesce(consensus, '') <> '' THEN 'consensus' ELSE 'copeland' END AS stage, tie_break AS key, count(*) AS steps FROM judged WHERE coalesce(tie_break, '') <> '' GROUP BY ALL""")
def AG30_tie_breaks(v: View) -> DataFrame:
    return va.tie_breaks(v("judged"), "seed")


@query("""WITH q AS (SELECT set_name, count(*) FILTER (candidate IS NOT NULL AND base IS NOT NULL) n, 100 * avg(candidate - base) p, count(*) FILTER (candidate > base) r, count(*) FILTER (candidate < base) w,
avg(candidate_s) / avg(base_s) t FROM trial_items GROUP BY set_name)
SELECT set_name AS "set", stage, kind, CASE WHEN stage = 'A' AND w - r >= 2 THEN 'drop' WHEN n = 0 THEN 'inconclusive' WHEN kind = 'output-fix' THEN CASE WHEN p >= least_q THEN adv ELSE 'drop' END
WHEN p >= least_q AND t <= most_t THEN adv WHEN NOT p >= least_q AND NOT t <= most_t THEN 'drop' ELSE 'inconclusive' END AS decision
FROM q, (VALUES ('A', 'advance'), ('B', 'finalist')) s(stage, adv), (VALUES ('speed', -2.0, 0.90), ('quality', 3.0, 1.05), ('output-fix', 0.0, 0.0)) k(kind, least_q, most_t)""")
def AG34_suggestions(v: View) -> DataFrame:
    return trials.suggestions(v("trial_items").withColumnRenamed("set_name", "set"))


@query("""WITH g AS (SELECT item, count(*) FILTER (outcome = 'failed' AND user_fault OR reason = 'invalid_output') broken, count(*) FILTER (outcome <> 'failed') completed FROM
(SELECT *, latency_ms % 2 = 1 AS user_fault FROM judged) x GROUP BY item)
SELECT item, broken, completed, 3 AS planned, CASE WHEN broken > 0 THEN 'malfunction' WHEN completed < 3 THEN 'out_of_budget' ELSE 'completed' END AS stop_reason,
CASE WHEN broken > 0 THEN 'drop' WHEN completed < 3 THEN 'inconclusive' ELSE 'advance' END AS suggestion FROM g""")
def AG34_stop_reasons(v: View) -> DataFrame:
    failed = F.col("outcome") == "failed"
    runs = v("judged").select("item", "reason", F.when(failed & (F.col("latency_ms") % 2 == 1), "exit 1").alias("error"), (~failed).alias("completed"))
    ended = trials.stop_reasons(runs, "item", F.lit(3))
    return ended.withColumn("suggestion", trials.stopped(F.lit("advance"), F.col("stop_reason")))


@query("""WITH c AS (SELECT assessment, cluster, avg(candidate - base) d, avg(candidate) q, count(*) FILTER (base IS NULL OR candidate IS NULL) m, count(*) FILTER (base = 1 AND candidate = 0) w FROM assessed GROUP BY ALL),
s AS (SELECT assessment, count(*) FILTER (m = 0) n, sum(m)::BIGINT m, sum(w)::BIGINT w, avg(d) FILTER (m = 0) dm, var_samp(d) FILTER (m = 0) dv, avg(q) FILTER (m = 0) qm, var_samp(q) FILTER (m = 0) qv FROM c GROUP BY assessment),
h AS (SELECT *, sqrt(2 * dv * ln(160) / n) + 14 * ln(160) / (3 * (n - 1)) dh, sqrt(2 * qv * ln(160) / n) + 7 * ln(160) / (3 * (n - 1)) qh FROM s),
b AS (SELECT *, greatest(-1, dm - dh) dl, least(1, dm + dh) du, greatest(0, qm - qh) ql, least(1, qm + qh) qu FROM h)
SELECT assessment, n AS clusters, m AS unmeasured, w AS regressions, round(dl, 6) AS delta_lo, round(du, 6) AS delta_hi, round(ql, 6) AS quality_lo, round(qu, 6) AS quality_hi,
CASE WHEN w > 5 THEN 'reject' WHEN m > 0 OR n < 20 THEN 'inconclusive' WHEN dl >= -0.4 AND ql >= 0.5 THEN 'adopt' WHEN du < -0.4 OR qu < 0.5 THEN 'reject' ELSE 'inconclusive' END AS recommendation FROM b""")
def AG35_recommendations(v: View) -> DataFrame:
    return trials.recommendations(v("assessed"), "assessment", 0.4, 0.5, 20, 5)


OUTCOME = """p AS (SELECT split, pair_id, max(task_id) task_id, max(CASE WHEN arm = 'edit' AND error_class = 'none' THEN pass::INT END)
 - max(CASE WHEN arm = 'base' AND error_class = 'none' THEN pass::INT END) outcome FROM trials GROUP BY ALL)"""
ROBIN = f"""{OUTCOME}, a AS (SELECT split, pair_id, outcome, row_number() OVER (PARTITION BY split ORDER BY pair_id) turn FROM p), f AS (SELECT * FROM a ORDER BY turn, split LIMIT 30)"""


@query(f"WITH {ROBIN} SELECT count(outcome) AS n, round(coalesce(avg((outcome <> 0)::INT), 0), 6) AS rate, coalesce(avg((outcome <> 0)::INT), 0) > 0.4 AS warned FROM f")
def AG44_WN13_discordance(v: View) -> DataFrame:
    return sequential.discordance(sequential.pair_outcomes(v("trials")))


@query("""WITH a AS (SELECT item, count(DISTINCT annotator) n, count(DISTINCT value) k FROM annotations GROUP BY item), s AS (SELECT CASE WHEN n >= 2 AND k = 1 THEN 'agreed' WHEN d.item IS NOT NULL THEN 'adjudicated' ELSE 'unresolved' END AS how
FROM a LEFT JOIN adjudications d ON a.item = d.item) SELECT how, count(*) AS n FROM s GROUP BY how""")
def AG47_merge_summary(v: View) -> DataFrame:
    return trials.resolve_labels(v("annotations"), v("adjudications")).groupBy("how").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT cluster, count(*) n, avg((first = second)::INT) po, avg((first = 'yes')::INT) * avg((second = 'yes')::INT) + avg((first = 'no')::INT) * avg((second = 'no')::INT) pe FROM agreement_rows GROUP BY cluster),
k AS (SELECT *, CASE WHEN pe < 1 THEN round((po - pe) / (1 - pe), 3) END kappa FROM c)
SELECT cluster, n, kappa, CASE WHEN kappa IS NULL THEN 'unmeasured' WHEN kappa >= 0.667 THEN 'yes' ELSE 'no' END AS verdict FROM k""")
def AG50_verdicts(v: View) -> DataFrame:
    share = lambda c: F.avg(c.cast("int"))
    first, second = F.col("first"), F.col("second")
    by = v("agreement_rows").groupBy("cluster").agg(
        F.count("*").alias("n"), share(first == second).alias("p_o"),
        (share(first == "yes") * share(second == "yes") + share(first == "no") * share(second == "no")).alias("p_e"), F.lit(False).alias("over_budget"),
    )
    return va.calibration_verdict(by).select("cluster", "n", "kappa", "verdict")


@query(f"""WITH {OUTCOME}, t AS (SELECT *, count(*) FILTER (outcome = -1) OVER w = count(*) OVER w lost, pair_id = max(pair_id) OVER w AS done FROM p WINDOW w AS (PARTITION BY split, task_id))
SELECT split, pair_id, count(*) FILTER (lost AND done) OVER (PARTITION BY split ORDER BY pair_id) AS lost_tasks FROM t""")
def WN02_lost_tasks(v: View) -> DataFrame:
    return sequential.running_lost(sequential.pair_outcomes(v("trials")))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) + 9000 AS seq FROM part")
def WN14_numbered(v: View) -> DataFrame:
    return mt.numbered(v("part").select("p_partkey"), 9000, "p_partkey", F.floor(F.col("p_partkey") / 50_000)).select("p_partkey", "seq")


@query("""WITH s AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) t FROM part GROUP BY p_brand)
SELECT p_brand, array_to_string(t[1:4], ', ') || CASE WHEN len(t) > 4 THEN ', and ' || (len(t) - 4) || ' more' ELSE '' END AS types FROM s""")
def OR04_listed(v: View) -> DataFrame:
    return v("part").groupBy("p_brand").agg(text.listed(F.array_sort(F.collect_set("p_type"))).alias("types"))


@query("""WITH s AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (side = 'left'), []) l, coalesce(list(DISTINCT event_type) FILTER (side = 'right'), []) r FROM user_sets GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_distinct(l || r)), ',') AS united, array_to_string(list_sort(list_filter(l, lambda x: NOT list_contains(r, x))), ',') AS missing,
list_sort(l) = list_sort(r) AS equal, list_has_all(r, l) AS subset FROM s""")
def ST01_ST04_sets(v: View) -> DataFrame:
    side = lambda s: F.collect_set(F.when(F.col("side") == s, F.col("event_type"))).alias(s)
    g = v("user_sets").groupBy("user_id").agg(side("left"), side("right"))
    return g.select("user_id", *(c.alias(n) for n, c in mt.set_report(F.col("left"), F.col("right")).items()))


@query("""WITH a AS (SELECT user_id, count(*) n FROM user_sets WHERE side = 'left' GROUP BY 1), b AS (SELECT user_id, count(*) n FROM user_sets WHERE side = 'right' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS "left", coalesce(b.n, 0) AS "right" FROM a FULL JOIN b ON a.user_id = b.user_id""")
def ST05_side_by_side(v: View) -> DataFrame:
    n = lambda s: v("user_sets").where(F.col("side") == s).groupBy("user_id").agg(F.count("*").alias("n"))
    return mt.side_by_side(n("left"), n("right"), "user_id", "n")


@query("SELECT user_id, event_type, count(*) AS n FROM user_sets GROUP BY ALL HAVING count(*) > 1")
def ST06_duplicates(v: View) -> DataFrame:
    return mt.duplicates(v("user_sets"), ["user_id", "event_type"])


@query("""WITH t AS (SELECT event_id, trim(regexp_replace(error, '[\\t-\\r \\x{85}\\x{A0}]+', ' ', 'g')) f FROM errors), h AS (SELECT *, list_max(list_filter(range(1, 161), lambda i: strlen(left(f, i)) <= 160)) k FROM t)
SELECT event_id, CASE WHEN strlen(f) > 160 THEN trim(left(f, k)) || ' […]' ELSE f END AS tidy FROM h""")
def SC02_tidied(v: View) -> DataFrame:
    return v("errors").select("event_id", text.tidy(F.col("error")).alias("tidy"))


@query("""WITH t AS (SELECT event_id, error, coalesce(try_cast(nullif(regexp_extract(error, 'HTTP ([0-9][0-9][0-9])', 1), '') AS INT), 0) s FROM errors)
SELECT event_id, s AS status, CASE WHEN s NOT BETWEEN 400 AND 499 THEN NULL WHEN error LIKE '%maximum context%' THEN 'context-length' WHEN s = 413 THEN 'payload-too-large' WHEN s = 429 THEN 'rate-limited'
WHEN s IN (401, 403) THEN 'not-authorised' ELSE 'http-' || s END AS reason FROM t""")
def SC03_SC04_requests(v: View) -> DataFrame:
    return v("errors").select("event_id", text.http_status(F.col("error")).alias("status"), text.http_reason(F.col("error")).alias("reason"))


@query("SELECT p_brand, CASE WHEN min(p_size) = max(p_size) THEN min(p_size)::VARCHAR ELSE min(p_size) || '-' || max(p_size) END AS sizes FROM part GROUP BY p_brand")
def SC05_spans(v: View) -> DataFrame:
    return v("part").groupBy("p_brand").agg(text.span(F.collect_set("p_size")).alias("sizes"))


@query(f"SELECT id, datediff('day', window_to, DATE '{STATUS_DAY}') AS age, window_to + INTERVAL 30 DAY >= DATE '{STATUS_DAY}' AS valid, CASE WHEN human_kappa IS NULL THEN 'unmeasured' ELSE printf('%.3f', human_kappa) END AS shown FROM calibrations")
def SC06_SC10_ages(v: View) -> DataFrame:
    day = F.lit(STATUS_DAY).cast("date")
    return v("calibrations").select("id", F.date_diff(day, "window_to").cast("long").alias("age"), (F.date_add("window_to", 30) >= day).alias("valid"),
                                    F.coalesce(text.fixed(F.col("human_kappa"), 3), F.lit("unmeasured")).alias("shown"))


@query("""SELECT p_partkey, CAST(list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(range(1, length(p_name) + 1), lambda i: ord(substr(p_name, i, 1))::HUGEINT), [0::HUGEINT],
list_transform(range(1, length(p_size::VARCHAR) + 1), lambda i: ord(substr(p_size::VARCHAR, i, 1))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) % 9223372036854775808 AS BIGINT) AS seed FROM part""")
def SC08_seeds(v: View) -> DataFrame:
    return v("part").select("p_partkey", text.fnv_seed(F.col("p_name"), F.col("p_size")).alias("seed"))


@query("""WITH t AS (SELECT p_partkey, '/srv/' || p_brand || '/' || p_partkey AS d FROM part)
SELECT p_partkey, CASE WHEN starts_with(d, '/srv/Brand#11/') THEN substr(d, 15) WHEN starts_with(d, '/srv/Brand#2') OR starts_with(d, '/srv/Brand#3') THEN substr(d, 6) ELSE substr(d, 6) END AS rel,
CASE WHEN starts_with(d, '/srv/Brand#11/') THEN 'at ' || substr(d, 15) ELSE 'at ~' || substr(d, 5) END AS said FROM t""")
def SC11_paths(v: View) -> DataFrame:
    d = F.concat(F.lit("/srv/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"))
    return v("part").select("p_partkey", text.record_path(d, ["/srv/Brand#11", "/srv"]).alias("rel"), text.scrub(F.concat(F.lit("at "), d), ["/srv/Brand#11"], "/srv").alias("said"))


@query("""SELECT o_orderkey, o_custkey % 3 AS kind, CASE o_custkey % 3 WHEN 0 THEN 'c' || o_custkey WHEN 1 THEN 'c' || o_custkey END AS name,
CASE WHEN o_custkey % 3 < 2 THEN o_orderdate::DATE END AS day, CASE WHEN o_custkey % 3 < 2 AND o_orderkey % 4 > 1 THEN (o_orderkey % 4)::INT END AS seq FROM orders""")
def SC12_identifiers(v: View) -> DataFrame:
    name, seq = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), (F.col("o_orderkey") % 4).cast("int")
    kind, day = F.col("o_custkey") % 3, F.col("o_orderdate").cast("date")
    of = lambda k: text.document_id(k, name, day, seq)
    rows = v("orders").select("o_orderkey", kind.alias("kind"), F.when(kind == 0, of("verifier")).when(kind == 1, of("calibration")).otherwise("verifier/C@2024-01-01").alias("id"))
    ver, cal = text.verifier_id_parts(F.col("id")), text.calibration_id_parts(F.col("id"))
    pick = lambda a, b: F.coalesce(ver[a], cal[b])
    return rows.select("o_orderkey", "kind", pick("task", "judge").alias("name"), pick("day", "day").alias("day"), pick("seq", "seq").alias("seq"))


@query("SELECT p_partkey, substr(regexp_replace(regexp_replace(lower('_' || p_name || '/' || p_type), '[^a-z0-9_-]', '-', 'g'), '^[-_]+', ''), 1, 64) AS label FROM part")
def SC13_labels(v: View) -> DataFrame:
    return v("part").select("p_partkey", text.label(F.concat(F.lit("_"), "p_name", F.lit("/"), "p_type")).alias("label"))


@query("""SELECT event_id, sha256('{"event":"' || event_type || '","k":' || (props->>'$.k') || '}') AS digest FROM events""")
def SC09_SC17_digests(v: View) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return v("events").select("event_id", text.subset_digest({"k": k, "event": F.col("event_type")}).alias("digest"))


@query("""SELECT printf('%03d-t%d', (user_id % 200)::BIGINT, (event_id % 2 + 1)::BIGINT) AS grp, event_id, CASE WHEN event_type IN ('view', 'click') THEN CASE event_type WHEN 'view' THEN 'first' ELSE 'second' END ELSE 'tie' END AS winner FROM events""")
def SRC14_votes(v: View) -> DataFrame:
    win = F.when(F.col("event_type") == "view", "first").when(F.col("event_type") == "click", "second").otherwise("tie")
    return v("events").select(F.format_string("%03d-t%d", F.col("user_id") % 200, F.col("event_id") % 2 + 1).alias("grp"), "event_id", win.alias("winner"))


@query("""WITH m AS (SELECT CASE WHEN user_id % 4 > 0 THEN 'u' ELSE 'm' END || user_id AS slug, list_sort(list(DISTINCT 'e' || event_type)) ev FROM events GROUP BY ALL),
x AS (SELECT CASE WHEN user_id % 3 = 0 AND value > 5 THEN 'u' ELSE 'k' END || user_id AS slug, CASE user_id % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN NULL ELSE 'open' END status, list_sort(list(DISTINCT 'e' || event_type)) ev FROM events GROUP BY slug, user_id)
SELECT coalesce(m.slug, x.slug) AS slug, CASE WHEN x.slug IS NULL THEN 'create' WHEN status IS NULL THEN 'unreadable' WHEN m.slug IS NULL THEN 'absent' WHEN status = 'resolved' THEN 'skip-closed'
WHEN list_has_all(x.ev, m.ev) THEN 'unchanged' ELSE 'append' END AS action,
array_to_string(list_sort(list_distinct(coalesce(x.ev, []) || coalesce(m.ev, []))), ',') AS evidence FROM m FULL JOIN x ON m.slug = x.slug""")
def SNK03_upserts(v: View) -> DataFrame:
    slug = lambda same, other: F.concat(F.when(F.expr(same), "u").otherwise(other), F.col("user_id").cast("string")).alias("slug")
    ev = F.array_sort(F.collect_set(F.concat(F.lit("e"), "event_type"))).alias("evidence")
    status = F.when(F.col("user_id") % 5 == 0, "resolved").when(F.col("user_id") % 5 != 1, "open").alias("status")
    mined = v("events").groupBy(slug("user_id % 4 > 0", "m")).agg(ev)
    known = v("events").groupBy(slug("user_id % 3 = 0 and value > 5", "k"), "user_id").agg(ev).select("slug", status, "evidence")
    return mining.plan_upsert(mined, known).withColumn("evidence", F.array_join("evidence", ","))
