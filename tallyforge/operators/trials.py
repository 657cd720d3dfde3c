"""Trials and assessments: quality, speed, plans, strata weights, cluster means, label resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.stats import empirical_bernstein, round_or_zero
from tallyforge.operators.ordering import ranked
from tallyforge.session import written


def quality(items: DataFrame) -> DataFrame:
    """AG-31: by set: items with a reference that were measured both ways, items without a reference, unmeasured ones, newly right and wrong, both
    means and the change in points. items: set, reference (null or empty: none), base, candidate scores (null: unmeasured)."""
    known = F.coalesce("reference", F.lit("")) != ""
    both = known & F.col("base").isNotNull() & F.col("candidate").isNotNull()
    mean = lambda c: F.avg(F.when(both, F.col(c)))
    return items.groupBy("set").agg(
        F.count_if(both).alias("evaluable"), F.count_if(~known).alias("no_reference"), F.count_if(known & ~both).alias("unmeasured"),
        F.count_if(both & (F.col("base") == 0) & (F.col("candidate") == 1)).alias("newly_right"), F.count_if(both & (F.col("base") == 1) & (F.col("candidate") == 0)).alias("newly_wrong"),
        F.round(mean("base"), 3).alias("q_base"), F.round(mean("candidate"), 3).alias("q_new"), round_or_zero(F.coalesce(100 * (mean("candidate") - mean("base")), F.lit(0.0))).alias("points"),
    )


def card_suggestions(items: DataFrame, cards: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """AG-31, AG-34 for every card: card, basis, evaluable, measured, why_not, points, newly_wrong, newly_right, ratio and decision.

    cards (a few settings of one trial): card, stage, kind, min_evaluable, min_per_stratum. items: set, stratum, reference, base,
    candidate, base_s, candidate_s. weights: stratum and share of the population that D stands for. Quality is read on D, at
    stage C on H; it is not measured where that set has no evaluable item, fewer than the card's floor, or, on D with weights, a
    weighted stratum with fewer than the card's number; with weights it is their mean. The early cut of stage A counts D and R together and
    comes before quality is read; then unmeasured quality, an output fix by quality alone, time that cannot be compared, both axes."""
    sets = quality(items)
    moved = sets.where(F.col("set").isin("D", "R")).agg(F.coalesce(F.sum("newly_wrong"), F.lit(0)).alias("newly_wrong"), F.coalesce(F.sum("newly_right"), F.lit(0)).alias("newly_right"))
    timed = items.where("base_s is not null and candidate_s is not null").agg(F.try_divide(F.avg("candidate_s"), F.avg("base_s")).alias("ratio"))
    basis = F.when(F.col("stage") == "C", "H").otherwise("D").alias("basis")
    rows = cards.select("*", basis).join(sets.select(F.col("set").alias("basis"), "evaluable", F.col("points").alias("raw")), "basis", "left").crossJoin(F.broadcast(moved)).crossJoin(F.broadcast(timed))
    if weights is not None:
        both = (F.coalesce("reference", F.lit("")) != "") & F.col("base").isNotNull() & F.col("candidate").isNotNull() & (F.col("set") == "D")
        by = items.where(both).groupBy("stratum").agg(F.count("*").alias("n"), F.avg("base").alias("b"), F.avg("candidate").alias("c"))
        j = weights.select("stratum", F.col("share").cast("double").alias("share")).join(by, "stratum", "left")
        value = 100 * (F.sum(F.col("share") * F.col("c")) - F.sum(F.col("share") * F.col("b"))) / F.sum("share")
        whole = j.agg(F.count("*").alias("strata"), F.coalesce(F.min(F.coalesce("n", F.lit(0))), F.lit(0)).alias("fewest"), round_or_zero(value).alias("weighted"))
    else:
        whole = cards.sparkSession.createDataFrame([(0, 0, None)], "strata long, fewest long, weighted double")
    rows = rows.crossJoin(F.broadcast(whole)).withColumn("evaluable", F.coalesce("evaluable", F.lit(0)))
    by_weights = (F.col("strata") > 0) & (F.col("basis") == "D")
    why_not = (
        F.when(F.col("evaluable") == 0, "none-evaluable").when(F.col("evaluable") < F.col("min_evaluable"), "below-floor").when(by_weights & (F.col("fewest") < F.col("min_per_stratum")), "thin-stratum")
    )
    rows = rows.withColumn("why_not", why_not).withColumn("points", F.when(F.col("why_not").isNull(), F.when(by_weights, F.col("weighted")).otherwise(F.col("raw"))))
    limit = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in THRESHOLDS.items() for x in (k, v[i]))), F.col("kind"))
    good, fast = F.col("points") >= limit(0), F.col("ratio") <= limit(1)
    advance = F.when(F.col("stage") == "A", "advance").otherwise("finalist")
    decision = (
        F.when((F.col("stage") == "A") & (F.col("newly_wrong") - F.col("newly_right") >= 2), "drop").when(F.col("why_not").isNotNull(), "inconclusive")
        .when(F.col("kind") == "output-fix", F.when(good, advance).otherwise("drop")).when(F.col("ratio").isNull(), "inconclusive")
        .when(good & fast, advance).when(~good & ~fast, "drop").otherwise("inconclusive")
    )
    return rows.select("card", "basis", "evaluable", F.col("why_not").isNull().alias("measured"), "why_not", "points", "newly_wrong", "newly_right", "ratio", decision.alias("decision"))


def weighted_quality(items: DataFrame, weights: DataFrame, least: int = 5) -> DataFrame:
    """AG-32: post-stratified change by set; null unless every weighted stratum has `least` items. weights: set, stratum, share."""
    d = items.where("base is not null and candidate is not null").groupBy("set", "stratum").agg(F.count("*").alias("n"), F.avg(F.col("candidate") - F.col("base")).alias("mean"))
    j = weights.join(d, ["set", "stratum"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    value = F.sum(F.col("share") * F.col("mean")) / F.sum("share")
    return j.groupBy("set").agg(F.when(F.bool_and(F.col("n") >= least), value).alias("weighted"), F.min("n").alias("fewest"))


def speed(items: DataFrame) -> DataFrame:
    """AG-33: mean and median seconds over items measured both ways, and the gain 1 - new / base."""
    m = items.where("base_s is not null and candidate_s is not null").agg(
        F.count("*").alias("n"), F.avg("base_s").alias("base_mean"), F.avg("candidate_s").alias("candidate_mean"),
        F.median("base_s").alias("base_median"), F.median("candidate_s").alias("candidate_median"),
    )
    return m.withColumn("gain", 1 - F.try_divide("candidate_mean", "base_mean"))


# Least change in points and largest time ratio of each kind of card.
THRESHOLDS = {"speed": (-2.0, 0.90), "quality": (3.0, 1.05), "output-fix": (0.0, 0.0)}


def suggestions(items: DataFrame) -> DataFrame:
    """AG-34: the decision for each set under both stages (A advances, later ones name a finalist) and each kind of card.

    At stage A two more newly wrong than newly right drop a change before quality is read; then unmeasured quality, an output
    fix by quality alone, time that cannot be compared, and both axes together."""
    both = F.col("base").isNotNull() & F.col("candidate").isNotNull()
    diff = F.when(both, F.col("candidate") - F.col("base"))
    timed = F.col("base_s").isNotNull() & F.col("candidate_s").isNotNull()
    q = items.groupBy("set").agg(
        F.count(diff).alias("n"), (100 * F.avg(diff)).alias("points"), (F.count_if(diff < 0) - F.count_if(diff > 0)).alias("worse"),
        F.try_divide(F.avg(F.when(timed, F.col("candidate_s"))), F.avg(F.when(timed, F.col("base_s")))).alias("ratio"),
    )
    cards = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(a).alias("advance"), F.lit(k).alias("kind"), F.lit(p).alias("least"), F.lit(t).alias("most"))
                      for s, a in (("A", "advance"), ("B", "finalist")) for k, (p, t) in THRESHOLDS.items()))
    rows = q.select("*", F.explode(cards).alias("c")).select("*", "c.*")
    good, fast = F.col("points") >= F.col("least"), F.col("ratio") <= F.col("most")
    decision = (
        F.when((F.col("stage") == "A") & (F.col("worse") >= 2), "drop").when(F.col("n") == 0, "inconclusive")
        .when(F.col("kind") == "output-fix", F.when(good, F.col("advance")).otherwise("drop")).when(F.col("ratio").isNull(), "inconclusive")
        .when(good & fast, F.col("advance")).when(~good & ~fast, "drop").otherwise("inconclusive")
    )
    return rows.select("set", "stage", "kind", decision.alias("decision"))


def cluster_means(items: DataFrame, value: str, cluster: str, by: str, lower: float, upper: float, alpha: float = 0.05) -> DataFrame:
    """AG-07, AG-35: empirical Bernstein over means of clusters whose items all have a value."""
    c = items.groupBy(by, cluster).agg(F.avg(value).alias("m"), F.bool_and(F.col(value).isNotNull()).alias("complete")).where("complete")
    s = c.groupBy(by).agg(F.count("*").alias("clusters"), F.avg("m").alias("mean"), F.var_samp("m").alias("v"))
    b = empirical_bernstein(F.col("clusters"), F.col("mean"), F.col("v"), lower, upper, alpha)
    return s.select(by, "clusters", "mean", b["lo"].alias("lo"), b["hi"].alias("hi"))


def stop_reasons(runs: DataFrame, by: str, planned: Column) -> DataFrame:
    """AG-34: why each trial ended: a broken run comes first, then planned items that were not completed. runs: error, reason, completed."""
    broken = F.count_if(F.coalesce(F.nullif("error", F.lit("")).isNotNull() | (F.col("reason") == "invalid_output"), F.lit(False)))
    g = runs.groupBy(by).agg(broken.alias("broken"), F.count_if("completed").alias("completed"), F.max(planned).alias("planned"))
    reason = F.when(F.col("broken") > 0, "malfunction").when(F.col("completed") == 0, F.when(F.col("planned") > 0, "out_of_budget").otherwise("undetermined"))
    return g.select(by, "broken", "completed", "planned", reason.when(F.col("completed") < F.col("planned"), "out_of_budget").otherwise("completed").alias("stop_reason"))


def stopped(decision: Column, stop_reason: Column) -> Column:
    """AG-34: what a stop leaves of a suggestion."""
    return F.when(stop_reason == "malfunction", "drop").when(stop_reason == "out_of_budget", "inconclusive").otherwise(decision)


def recommendations(items: DataFrame, by: str, margin: float, floor: float, least_clusters: int, most_regressions: int, alpha: float = 0.05) -> DataFrame:
    """AG-35: adopt, reject or inconclusive for each assessment. items: cluster, base, candidate (null: unmeasured).

    More items that went from right to wrong than allowed reject before anything else; then a missing score or too few clusters
    leave it open; then the intervals of the clusters' mean difference and candidate quality, each at half of alpha."""
    base, candidate = F.col("base"), F.col("candidate")
    c = items.groupBy(by, "cluster").agg(
        F.avg(candidate - base).alias("delta"), F.avg("candidate").alias("quality"), F.count_if(base.isNull() | candidate.isNull()).alias("missing"),
        F.count_if((base == 1) & (candidate == 0)).alias("worse"),
    )
    whole = lambda x: F.when(F.col("missing") == 0, F.col(x))
    s = c.groupBy(by).agg(
        F.count(whole("delta")).alias("clusters"), F.sum("missing").alias("unmeasured"), F.sum("worse").alias("regressions"),
        *(f(whole(x)).alias(f"{x}_{k}") for x in ("delta", "quality") for k, f in (("mean", F.avg), ("v", F.var_samp))),
    )
    d = empirical_bernstein(F.col("clusters"), F.col("delta_mean"), F.col("delta_v"), -1.0, 1.0, alpha / 2)
    q = empirical_bernstein(F.col("clusters"), F.col("quality_mean"), F.col("quality_v"), 0.0, 1.0, alpha / 2)
    word = (
        F.when(F.col("regressions") > most_regressions, "reject").when((F.col("unmeasured") > 0) | (F.col("clusters") < least_clusters), "inconclusive")
        .when((d["lo"] >= -margin) & (q["lo"] >= floor), "adopt").when((d["hi"] < -margin) | (q["hi"] < floor), "reject").otherwise("inconclusive")
    )
    return s.select(by, "clusters", "unmeasured", "regressions", d["lo"].alias("delta_lo"), d["hi"].alias("delta_hi"), q["lo"].alias("quality_lo"), q["hi"].alias("quality_hi"), word.alias("recommendation"))


def interleave(items: DataFrame, key: str, d: str = "D", r: str = "R") -> DataFrame:
    """WN-09: R_i stands after D_round(i d / (r + 1)). items: set and key."""
    both = items.where(F.col("set").isin(d, r))
    n = both.agg(F.count_if(F.col("set") == d).alias("d"), F.count_if(F.col("set") == r).alias("r"))
    after = F.floor((2 * F.col("i") * F.col("d") + F.col("r") + 1) / (2 * (F.col("r") + 1)))
    placed = ranked(both, ["set"], [F.col(key)], place="i").crossJoin(F.broadcast(n)).withColumn("after", F.when(F.col("set") == d, F.col("i")).otherwise(after).cast("long"))
    return placed.select("set", key, "i", "after", (F.col("set") == r).cast("int").alias("second"))


def blocks(items: DataFrame, key: str, size: int, conditions: tuple[str, str] = ("base", "candidate")) -> DataFrame:
    """WN-10: items by rank in blocks; odd blocks swap the order of conditions."""
    block = F.floor((F.col("_place") - 1) / size)
    first, second = conditions
    order = F.when(block % 2 == 0, F.array(F.lit(first), F.lit(second))).otherwise(F.array(F.lit(second), F.lit(first)))
    placed = ranked(items.select("set", key), ["set"], [F.col(key)], place="_place")
    return placed.select("set", key, block.alias("block"), order.alias("o")).select("set", key, "block", F.posexplode("o").alias("turn", "condition"))


def switches(plan: DataFrame, key: str) -> DataFrame:
    """WN-11: changes of condition along each set's plan: every step is joined with the one before it by its place."""
    steps = written(ranked(plan, ["set"], [F.col("block"), F.col("turn"), F.col(key)], place="_place").select("set", "_place", "condition"))
    before = steps.select("set", (F.col("_place") + 1).alias("_place"), F.col("condition").alias("_last"))
    joined = steps.join(before, ["set", "_place"], "left")
    return joined.groupBy("set").agg(F.count_if(F.col("_last").isNotNull() & (F.col("_last") != F.col("condition"))).alias("switches"))


def schedule(tasks: DataFrame, key: str, repeats: int, cap: int) -> DataFrame:
    """WN-12: repeat-major order of tasks, capped; and how often each task then runs."""
    every = tasks.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = ranked(every, ["split"], [F.col("repeat"), F.col(key)]).where(F.col("place") <= cap)
    return rows.withColumn("task_repeats", F.count("*").over(Window.partitionBy("split", key)))


def resolve_labels(labels: DataFrame, adjudications: DataFrame) -> DataFrame:
    """AG-47, AG-48: an item's annotators' value if at least two agree in all; else the adjudicated one; else unresolved."""
    a = labels.groupBy("item").agg(F.countDistinct("annotator").alias("annotators"), F.countDistinct("value").alias("kinds"), F.min("value").alias("value"))
    j = a.join(adjudications.select("item", F.col("value").alias("adjudicated")), "item", "left")
    agreed = (F.col("annotators") >= 2) & (F.col("kinds") == 1)
    return j.select("item", F.when(agreed, F.col("value")).otherwise(F.col("adjudicated")).alias("resolved"),
                    F.when(agreed, "agreed").when(F.col("adjudicated").isNotNull(), "adjudicated").otherwise("unresolved").alias("how"))
