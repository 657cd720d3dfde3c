"""The paired sequential gate: outcomes, running evidence, readings, stopping and promotion."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.stats import delta_cs, log_e
from tallyforge.operators.ordering import ranked


@dataclass(frozen=True)
class Params:
    """alpha of the gate, the margin of a hold, and the most lost tasks (-1: no count gate)."""

    alpha: float = 0.05
    margin: float = 0.15
    most_lost: int = -1


def pair_outcomes(trials: DataFrame) -> DataFrame:
    """JN-02, PRJ-06: both arms of a pair side by side: 1 edit alone passed, -1 base alone, 0 tie; null while an arm has no answer."""
    arms = trials.groupBy("split", "pair_id").agg(
        F.max("task_id").alias("task_id"),
        *(F.max(F.when((F.col("arm") == a) & (F.col("error_class") == "none"), F.col("pass").cast("int"))).alias(a) for a in ("base", "edit")),
        *(F.count_if(F.col("arm") == a).alias(f"n_{a}") for a in ("base", "edit")),
    )
    return arms.select("split", "pair_id", "task_id", (F.col("edit") - F.col("base")).alias("outcome"), ((F.col("n_base") != 1) | (F.col("n_edit") != 1)).alias("anomaly"))


def evidence(pairs: DataFrame, by: list[str]) -> DataFrame:
    """AG-08: wins, losses, ties, and tasks whose pairs are all complete and all lost."""
    task = pairs.groupBy(*by, "task_id").agg(
        F.count_if(F.col("outcome") == 1).alias("b"), F.count_if(F.col("outcome") == -1).alias("c"), F.count_if(F.col("outcome") == 0).alias("ties"),
        (F.count_if(F.col("outcome") == -1) == F.count("*")).alias("lost"),
    )
    return task.groupBy(*by).agg(F.sum("b").alias("b"), F.sum("c").alias("c"), F.sum("ties").alias("ties"), F.count_if("lost").alias("lost_tasks"))


def verdict(b: Column, c: Column, ties: Column, lost: Column, p: Params, e: Column | None = None, delta: Column | None = None) -> Column:
    """AG-12: regress before improve before hold, else inconclusive. e and delta: log_e and delta_cs where they are known.

    An improvement is never below the margin: at 2 / alpha its theta, and so its delta, cannot be under none."""
    e = log_e(b, c) if e is None else e
    delta = delta_cs(b, c, b + c + ties, p.alpha) if delta is None else delta
    harm = (c > b) & (e >= math.log(1 / p.alpha))
    gain = (b > c) & (e >= math.log(2 / p.alpha))
    over = F.lit(False) if p.most_lost < 0 else lost > p.most_lost
    hold = (b + c + ties > 0) & (delta["lo"] >= -p.margin)
    return F.when(harm | over, "regress").when(gain, "improve").when(hold, "hold").otherwise("inconclusive")


def readings(ev: DataFrame, p: Params = Params()) -> DataFrame:
    b, c, ties = F.col("b"), F.col("c"), F.col("ties")
    known = ev.select("*", log_e(b, c).alias("log_e"), delta_cs(b, c, b + c + ties, p.alpha).alias("_delta"))
    v = verdict(b, c, ties, F.col("lost_tasks"), p, F.col("log_e"), F.col("_delta"))
    return known.select("*", F.col("_delta.lo").alias("delta_lo"), F.col("_delta.hi").alias("delta_hi"), v.alias("verdict")).drop("_delta")


def running_sums(pairs: DataFrame, order: str, sums: dict[str, Column]) -> DataFrame:
    """pairs with the sums of a split's pairs up to each, by their order (null first)."""
    return ranked(pairs, ["split"], [F.col(order)], sums, place="_place").drop("_place")


def running(pairs: DataFrame, order: str = "pair_id") -> DataFrame:
    """WN-01: evidence after each answered pair of a split."""
    hit = lambda k: F.col("outcome") == k
    answered = pairs.where("outcome is not null").select("split", order, "outcome")
    return running_sums(answered, order, {"cum_b": hit(1), "cum_c": hit(-1), "cum_ties": hit(0), "n": F.lit(1)})


def running_lost(pairs: DataFrame, order: str = "pair_id") -> DataFrame:
    """WN-02: tasks lost so far after each pair: a task counts at its last pair, if all its pairs were lost."""
    tasks = pairs.groupBy("split", "task_id").agg((F.count_if(F.col("outcome") == -1) == F.count("*")).alias("lost"), F.max(order).alias(order))
    ends = tasks.where("lost").groupBy("split", order).agg(F.count("*").alias("_ends"))
    marked = pairs.select("split", order).join(ends, ["split", order], "left").withColumn("_ends", F.coalesce("_ends", F.lit(0)))
    return running_sums(marked, order, {"lost_tasks": F.col("_ends")}).select("split", order, "lost_tasks")


def stop_at(pairs: DataFrame, p: Params = Params(), batch: int = 10, order: str = "pair_id") -> DataFrame:
    """WN-03: after how many scheduled pairs a split stops: the end of the first batch (or of the last, short one) at which it has
    improved or regressed; null where none does. Pairs without an answer fill a batch like others; a breached count of lost tasks
    is a regression."""
    hit = lambda k: F.coalesce(F.col("outcome") == k, F.lit(False))
    sums = {"cum_b": hit(1), "cum_c": hit(-1), "answered": F.col("outcome").isNotNull(), "n": F.lit(1)}
    rows = running_sums(pairs.select("split", order, "outcome"), order, sums)
    if p.most_lost >= 0:
        rows = rows.join(running_lost(pairs, order), ["split", order])
    total = pairs.groupBy(F.col("split").alias("_split")).agg(F.count("*").alias("pairs"))  # a row for each of the gate's two splits
    ends = rows.join(F.broadcast(total), F.col("split").eqNullSafe(F.col("_split"))).where((F.col("n") % batch == 0) | (F.col("n") == F.col("pairs")))
    e = log_e(F.col("cum_b"), F.col("cum_c"))
    decided = F.when(F.col("cum_b") > F.col("cum_c"), e >= math.log(2 / p.alpha)).otherwise((F.col("cum_c") > F.col("cum_b")) & (e >= math.log(1 / p.alpha)))
    if p.most_lost >= 0:
        decided = decided | (F.col("lost_tasks") > p.most_lost)
    first = F.min(F.when(decided, F.struct("n", "answered")))
    return ends.groupBy("split").agg(first["n"].alias("stop_n"), first["answered"].alias("stop_answered"), F.max("pairs").alias("pairs"))


def unanswered_runs(pairs: DataFrame, order: str = "pair_id", most: int = 5) -> DataFrame:
    """WN-04: the longest run of pairs without an answer in each split, and whether it aborts."""
    islands = running_sums(pairs.select("split", order, "outcome"), order, {"island": F.col("outcome").isNotNull()})
    runs = islands.where("outcome is null").groupBy("split", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("split").agg(F.max("n").alias("longest"), (F.max("n") >= most).alias("aborts"))


def promote(read: DataFrame) -> DataFrame:
    """AG-13: both splits improve or hold, and one improves."""
    v = lambda s: F.max(F.when(F.col("split") == s, F.col("verdict")))
    two = read.agg(v("held-in").alias("held_in"), v("held-out").alias("held_out"))
    fine = lambda c: F.coalesce(F.col(c).isin("improve", "hold"), F.lit(False))
    better = (F.col("held_in") == "improve") | (F.col("held_out") == "improve")
    return two.select("held_in", "held_out", (fine("held_in") & fine("held_out") & F.coalesce(better, F.lit(False))).alias("promote"))


def discordance(pairs: DataFrame, most: int = 30, warn: float = 0.4) -> DataFrame:
    """AG-44, WN-13: share of unlike pairs among those answered of the first `most` scheduled, taken round-robin over splits."""
    turn = F.row_number().over(Window.partitionBy("split").orderBy("pair_id"))
    heads = pairs.withColumn("turn", turn).where(F.col("turn") <= most)  # cut in each task before the shuffle
    first = heads.orderBy("turn", "split").limit(most)
    rate = F.coalesce(F.try_divide(F.count_if(F.col("outcome") != 0), F.count("outcome")), F.lit(0.0))
    return first.agg(F.count("outcome").alias("n"), rate.alias("rate"), (rate > warn).alias("warned"))
