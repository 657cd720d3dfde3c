"""Validity of a judge: what its runs say, swaps and position, routes, scores, standing and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.stats import kappa, z_for
from tallyforge.operators import agreement

ABSTAIN, UNSTATED = "abstain", "unstated"
# How a table reads abstentions.
WHOLE, DECIDED = "abstain-as-category", "decided-only"
# Days for which a calibration holds, and the least kappa (to 3 places) that validates.
VALIDITY_DAYS, LEAST_KAPPA = 30, 0.667


def category(outcome: Column, candidate: Column) -> Column:
    """PRJ-01."""
    return F.when(outcome == "selected", candidate).otherwise(ABSTAIN)


def measured(outcome: Column) -> Column:
    """PRJ-02."""
    return F.coalesce(outcome.isin("selected", "no_candidate"), F.lit(False))


def rule(outcome: Column, consensus: Column, reason: Column, tie_break: Column) -> Column:
    """PRJ-03: what settled a selection; null where nothing was selected. Empty texts count as absent."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    starts = lambda word: F.coalesce(reason.startswith(word), F.lit(False))
    settled = F.when(has(consensus), "consensus").when(starts("condorcet"), "condorcet").when(has(tie_break), "tie_break").when(starts("copeland"), "copeland")
    return F.when(outcome == "selected", settled.otherwise(UNSTATED))


def folded(choice: Column) -> Column:
    """PRJ-04: ties and all-bad read as abstentions."""
    return F.when(choice.isin("tie", "all_bad"), ABSTAIN).otherwise(choice)


def references(labels: DataFrame, gold: DataFrame) -> DataFrame:
    """JN-04, WN-07: item, category and origin: the least labeler's choice, else the gold."""
    first = labels.groupBy("item").agg(F.min(F.struct("labeler", "choice"))["choice"].alias("label"))
    both = first.join(gold.select("item", "gold"), "item", "full")
    origin = F.when(F.col("label").isNotNull(), "label").otherwise("gold")
    return both.select("item", folded(F.coalesce("label", "gold")).alias("category"), origin.alias("origin"))


def route(consensus: Column, tie_break: Column, settled: Column, is_measured: Column) -> Column:
    """PRJ-08: how a run came to its result."""
    return F.coalesce(F.concat(F.lit("consensus/"), F.nullif(consensus, F.lit(""))), F.concat(F.lit("tie_break/"), F.nullif(tie_break, F.lit(""))), settled,
                      F.when(is_measured, "judge").otherwise("unmeasured"))


def trial_score(outcome: Column, candidate: Column, reference: Column) -> Column:
    """PRJ-09: 1 for the reference, 0 for another or none; null without a reference or a judgement."""
    of = F.when(outcome == "selected", (candidate == reference).cast("int")).when(outcome == "no_candidate", 0)
    return F.when(F.coalesce(reference, F.lit("")) != "", of)


def assessment_score(outcome: Column, reason: Column, candidate: Column, all_bad: Column, acceptable: Column, positions: list[str]) -> Column:
    """PRJ-10: 1 if an acceptable candidate was selected; null where output was invalid or the candidate is no position."""
    none = F.when(F.coalesce(reason == "invalid_output", F.lit(False)), None).otherwise(0.0)
    good = F.when(all_bad, 0.0).when(F.array_contains(acceptable, candidate), 1.0).otherwise(0.0)
    return F.when(outcome == "no_candidate", none).when((outcome == "selected") & candidate.isin(positions), good)


def routes(scored: DataFrame) -> DataFrame:
    """AG-36: scored: side, route, outcome, consensus, score."""
    has = F.coalesce("consensus", F.lit("")) != ""
    return scored.groupBy("side", "route").agg(
        F.count("*").alias("items"), F.count_if(F.col("score").isNull()).alias("unmeasured"),
        F.count_if((F.col("outcome") == "selected") & F.col("score").isNotNull()).alias("selected"),
        F.count_if(F.col("score") == 1).alias("correct"), F.count_if(has & (F.col("score") == 0)).alias("wrong_consensus"),
    )


def calls(orders: DataFrame) -> DataFrame:
    """PRJ-07: orders (item, pair_id, ord, first, second, choice) with decided, chose_first and side: the one named, or abstain."""
    decided = F.col("choice").isin("first", "second")
    side = F.when(F.col("choice") == "first", F.col("first")).when(F.col("choice") == "second", F.col("second")).otherwise(ABSTAIN)
    return orders.withColumns({"decided": F.coalesce(decided, F.lit(False)), "chose_first": F.coalesce(F.col("choice") == "first", F.lit(False)), "side": side})


def swaps(called: DataFrame) -> DataFrame:
    """Pairs judged in exactly two orders, side by side."""
    at = lambda k, c: F.max(F.when(F.col("ord") == k, F.col(c))).alias(f"{c}_{k}")
    two = called.groupBy("item", "pair_id").agg(F.count("*").alias("n"), *(at(k, c) for k in (1, 2) for c in ("side", "decided", "chose_first")))
    return two.where("n = 2 and side_1 is not null and side_2 is not null")


def swap_table(called: DataFrame) -> DataFrame:
    """AG-15: how often each side in the first order met each in the second."""
    return swaps(called).groupBy(F.col("side_1").alias("first"), F.col("side_2").alias("second")).agg(F.count("*").alias("n"))


def flip_rate(called: DataFrame, alpha: float = 0.05) -> DataFrame:
    """AG-15: flips among pairs decided both ways, clustered by item."""
    both = swaps(called).where("decided_1 and decided_2")
    return agreement.clustered_proportion(both, F.col("side_1") != F.col("side_2"), "item", alpha)


def position_bias(called: DataFrame, alpha: float = 0.05) -> DataFrame:
    """AG-16: how often decided calls name the first place, clustered by item, and its distance from a half."""
    p = agreement.clustered_proportion(called.where("decided"), F.col("chose_first"), "item", alpha)
    return p.withColumn("bias", F.abs(F.col("rate") - 0.5))


def disagreements(called: DataFrame) -> DataFrame:
    """AG-17: of pairs drawn for disagreement, those that named the first place twice, the second twice, or else."""
    drawn = called.where("draw_reason = 'disagree'").groupBy("item", "pair_id").agg(
        F.count("*").alias("n"), F.bool_and("decided").alias("decided"), F.count_if("chose_first").alias("firsts")
    )
    both = F.col("decided") & (F.col("n") == 2)
    return drawn.agg(
        F.count("*").alias("pairs"), F.count_if(both & (F.col("firsts") == 2)).alias("both_first"), F.count_if(both & (F.col("firsts") == 0)).alias("both_second"),
        F.count_if(~both | (F.col("firsts") == 1)).alias("other"),
    )


def counters(runs: DataFrame) -> DataFrame:
    """AG-19: counts by dimension and value, in one pass: outcome, rule, tie-break, consensus, and why there was no candidate."""
    name = lambda d, c: F.struct(F.lit(d).alias("dimension"), c.alias("value"))
    why = F.when(F.col("outcome") == "no_candidate", F.coalesce(F.nullif("reason", F.lit("")), F.lit(UNSTATED)))
    dims = F.array(name("outcome", F.col("outcome")), name("reason", why), name("rule", F.col("rule")), name("tie_break", F.col("tie_break")), name("consensus", F.col("consensus")))
    flat = runs.select(F.explode(F.filter(dims, lambda d: d["value"].isNotNull())).alias("d"))
    return flat.groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"))


def calibration_verdict(by_group: DataFrame, least: float = LEAST_KAPPA) -> DataFrame:
    """AG-50: by_group: n, p_o, p_e and over_budget. Kappa is compared as it is printed, to 3 places."""
    k = F.round(kappa(F.col("p_o"), F.col("p_e")), 3)
    unknown = F.col("over_budget") | (F.col("n") == 0) | k.isNull()
    return by_group.withColumns({"kappa": k, "verdict": F.when(unknown, "unmeasured").when(k >= least, "yes").otherwise("no")})


def first_runs(runs: DataFrame) -> DataFrame:
    """The run of the least seed of every item. runs: item, seed, category, measured, calls."""
    return runs.groupBy("item").agg(F.min_by(F.struct("seed", "category", "measured", "calls"), "seed").alias("r")).select("item", "r.*")


def calibration_pairs(runs: DataFrame, labels: DataFrame, gold: DataFrame, called: DataFrame) -> DataFrame:
    """AG-14: every comparison of a report: measure, handling, item, answer, other.

    swap: the sides named in both orders of a pair; rerun: the first seed's category beside each later measured one; gold, labels,
    human (the label, else the gold) and human_judge_decided (only items with judge calls): the first seed's category beside
    theirs. An item whose first run is not measured is in none of the last five. Comparisons with people are read twice:
    with abstention as a category, and over those where neither abstains."""
    one = first_runs(runs).where("measured")
    later = one.select("item", F.col("seed").alias("_seed"), F.col("category").alias("answer")).join(runs.where("measured"), "item").where("seed > _seed")
    label = labels.groupBy("item").agg(F.min(F.struct("labeler", "choice"))["choice"].alias("label"))
    said = one.join(label, "item", "left").join(gold.select("item", "gold"), "item", "left")
    at = lambda name, c: F.struct(F.lit(name).alias("measure"), c.alias("other"))
    human = folded(F.coalesce("label", "gold"))
    four = F.array(at("gold", folded(F.col("gold"))), at("labels", folded(F.col("label"))), at("human", human), at("human_judge_decided", F.when(F.col("calls") > 0, human)))
    people = said.select("item", F.col("category").alias("answer"), F.explode(four).alias("m")).select("item", "answer", "m.*").where("other is not null")
    decided = (F.col("answer") != ABSTAIN) & (F.col("other") != ABSTAIN)
    ways = F.when(decided, F.array(F.lit(WHOLE), F.lit(DECIDED))).otherwise(F.array(F.lit(WHOLE)))
    plain = lambda df, name, a, b: df.select(F.lit(name).alias("measure"), F.lit(WHOLE).alias("handling"), "item", F.col(a).alias("answer"), F.col(b).alias("other"))
    return (
        plain(swaps(called), "swap", "side_1", "side_2").unionByName(plain(later, "rerun", "answer", "category"))
        .unionByName(people.select("measure", F.explode(ways).alias("handling"), "item", "answer", "other"))
    )


def calibration(pairs: DataFrame, categories: list[str], over_budget: Column, alpha: float = 0.05) -> DataFrame:
    """AG-14, AG-50: agreement of every measure and handling, and the verdict, which reads the human reference alone."""
    rows = agreement.agreement_by(pairs, ["measure", "handling"], "answer", "other", "item", categories, alpha)
    judged = calibration_verdict(rows.withColumn("over_budget", over_budget)).withColumnRenamed("kappa", "_printed")
    binding = (F.col("measure") == "human") & (F.col("handling") == WHOLE)
    return rows.join(judged.select("measure", "handling", "verdict"), ["measure", "handling"]).withColumn("verdict", F.when(binding, F.col("verdict")))


def standing(calibrations: DataFrame, day: str) -> DataFrame:
    """JN-12, AG-49: what binds on a day, the last comparison with people, and whether to warn.

    calibrations: id, window_to, human_kappa (null: unmeasured), verdict. One binds for VALIDITY_DAYS from its window's end."""
    today, compared = F.lit(day).cast("date"), F.col("human_kappa").isNotNull()
    binds = (F.col("window_to") <= today) & (F.date_diff(today, F.col("window_to")) <= VALIDITY_DAYS)
    past = calibrations.where(F.col("window_to") <= today)
    last = F.min(F.when(compared, F.struct((-F.unix_date("window_to")).alias("d"), F.col("id").alias("id"))))
    s = past.agg(
        F.count_if(binds).alias("binding"), F.count_if(binds & compared).alias("binding_compared"), F.count_if(binds & (F.col("verdict") == "no")).alias("binding_refused"),
        last["id"].alias("last_human"), (-last["d"]).alias("_last"),
    )
    days = (F.unix_date(today) - F.col("_last")).cast("long")
    return s.select(
        "binding", "binding_compared", "binding_refused", "last_human", days.alias("days_since"), F.col("last_human").isNull().alias("never_compared"),
        F.coalesce(days > VALIDITY_DAYS, F.lit(False)).alias("stale"), (F.col("binding") == 0).alias("nothing_binds"),
        ((F.col("binding") > 0) & (F.col("binding_compared") == 0)).alias("only_self_consistent"),
    )


def rescored(recorded: DataFrame, again: DataFrame) -> DataFrame:
    """JN-14: recorded and rescored runs by item and seed: how many are alike, changed, or on one side only."""
    r = recorded.select("item", "seed", F.struct("outcome", "candidate").alias("was"))
    a = again.select("item", "seed", F.struct("outcome", "candidate").alias("is"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("was").eqNullSafe(F.col("is")), "same").otherwise("changed")
    return r.join(a, ["item", "seed"], "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def conditions(runs: DataFrame, by: str) -> DataFrame:
    """AG-30: the steps of each condition by what came of them, coverage (selected over steps), seconds on the wall of the steps that
    have them, the mean recorded latency, and steps settled by consensus. A step with an error is unmeasured whatever its outcome."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    which = lambda word: F.count_if(~failed & F.coalesce(F.col("outcome") == word, F.lit(False)))
    selected, abstained = which("selected"), which("no_candidate")
    return runs.groupBy(by).agg(
        F.count("*").alias("steps"), selected.alias("selected"), abstained.alias("no_candidate"), (F.count("*") - selected - abstained).alias("unmeasured"), F.count_if(failed).alias("errors"),
        F.round(F.try_divide(selected, F.count("*")), 3).alias("coverage"), F.round(F.avg("wall_seconds"), 3).alias("mean_wall_seconds"), F.round(F.median("wall_seconds"), 3).alias("median_wall_seconds"),
        F.round(F.try_divide(F.sum(F.coalesce("latency_ms", F.lit(0))), F.count("*")), 3).alias("recorded_latency_ms_mean"), F.count_if(F.coalesce("consensus", F.lit("")) != "").alias("consensus_steps"),
    )


def tie_breaks(runs: DataFrame, by: str) -> DataFrame:
    """AG-30: steps that a key had to part, by condition, stage (consensus, or the score) and key."""
    stage = F.when(F.coalesce("consensus", F.lit("")) != "", "consensus").otherwise("copeland")
    return runs.where(F.coalesce("tie_break", F.lit("")) != "").groupBy(by, stage.alias("stage"), F.col("tie_break").alias("key")).agg(F.count("*").alias("steps"))


def half_width(rate: Column, n: Column, alpha: float = 0.05) -> Column:
    """AG-06: the normal half width of a rate over n independent trials."""
    return F.lit(z_for(alpha)) * F.sqrt(rate * (1 - rate) / n)


def take(items: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """PRJ-15, OR-02: the first n of each set in file order."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return items.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
