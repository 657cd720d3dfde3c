"""Verifier health: doctor aggregates and verdicts, tolerance bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.selection import medians

# Two-sided 95 % / 95 % normal tolerance factors for 5 to 12 runs.
TOLERANCE = {5: 4.164, 6: 3.730, 7: 3.464, 8: 3.268, 9: 3.128, 10: 3.021, 11: 2.935, 12: 2.865}


def outcome(status: Column) -> Column:
    """PRJ-11."""
    return F.when(status == "fail", "killed").when(status == "pass", "survived").otherwise("inconclusive")


def doctor_summary(runs: DataFrame, kill_rate_min: float = 0.8) -> DataFrame:
    """AG-27, AG-28: counts by task, kill rate (null without settled mutants), whether it means anything, and the verdict.

    A rate means something if no reference failed and some reference passed. A mutant written by hand (origin = 'hand')
    that was to be killed and survived is unhealthy whatever the rate."""
    ref, mutant = F.col("kind") == "reference", (F.col("kind") == "mutant") & (F.col("expect") != "equivalent")
    equivalent = (F.col("kind") == "mutant") & (F.col("expect") == "equivalent")
    done = outcome(F.col("status"))
    by_hand = (F.col("origin") == "hand") if "origin" in runs.columns else F.lit(False)
    out = runs.groupBy("task").agg(
        F.count_if(ref).alias("references"), F.count_if(ref & (F.col("status") == "fail")).alias("failed_references"),
        F.count_if(ref & ~F.col("status").isin("fail", "pass")).alias("unsettled_references"),
        *(F.count_if(mutant & (done == k)).alias(k) for k in ("killed", "survived", "inconclusive")),
        F.count_if(equivalent).alias("equivalent"), F.count_if(equivalent & (done == "inconclusive")).alias("unsettled_equivalent"),
        F.count_if(mutant & by_hand & (F.col("expect") == "killed") & (done == "survived")).alias("hand_survivors"),
    ).withColumn("kill_rate", F.try_divide(F.col("killed"), F.col("killed") + F.col("survived")))
    means = (F.col("failed_references") == 0) & (F.col("unsettled_references") < F.col("references"))
    unsettled = F.col("kill_rate").isNull() | (F.col("unsettled_references") + F.col("inconclusive") + F.col("unsettled_equivalent") > 0)
    v = (
        F.when((F.col("failed_references") > 0) | (F.col("hand_survivors") > 0), "unhealthy").when(~means, "inconclusive")
        .when(F.col("kill_rate") < kill_rate_min, "unhealthy").when(unsettled, "inconclusive").otherwise("healthy")
    )
    return out.withColumns({"meaningful": means, "verdict": v})


def beyond_reference(runs: DataFrame) -> DataFrame:
    """AG-29: bands that mutants failed and no reference did, by task."""
    failed = runs.select("task", "kind", F.explode("band_failed").alias("band")).distinct()
    ref = failed.where("kind = 'reference'").select("task", "band")
    return failed.where("kind = 'mutant'").select("task", "band").distinct().join(ref, ["task", "band"], "left_anti")


def spread(obs: DataFrame, by: str, value: str = "value") -> DataFrame:
    """AG-21: n, averaging median, mean, sample deviation (0 under two) and scaled median absolute deviation."""
    mid = medians(obs, by, value).join(obs.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd")), by)
    away = obs.join(mid.select(by, "median"), by).select(by, F.abs(F.col(value) - F.col("median")).alias("away"))
    mad = medians(away, by, "away").select(by, (F.col("median") * 1.4826).alias("mad"))
    return mid.join(mad, by)


def outward(x: Column, up: bool, places: int = 4) -> Column:
    return (F.ceil(x * 10**places) if up else F.floor(x * 10**places)) / F.lit(float(10**places))


def derive_bands(obs: DataFrame, by: str, ci_factor: float = 0.0, relative: float = 0.02, floor_us: float = 0.1, floor_ms: float = 0.005,
                 k: float | None = None, keep: tuple[str, ...] = (), lower: str = "derive",
                 centre: str = "median", spread_by: str = "stdev") -> DataFrame:
    """AG-22, AG-23, AG-25: one row an invariant, with why its band is what it is.

    obs: the invariant's name, value, ci_half, and band_lo and band_hi, the band it was judged against. In this order: bands
    named in keep stay (declared), bands that hold every value stay (in-band), whole values against a band of whole
    numbers are refused (quantised), as are numbers of runs without a tolerance factor (no-factor; k stands for it) and
    widths of zero (no-width). Other bands are derived: the centre, and the widest of the terms on each side (the first of
    equal ones binds), rounded outward. centre: median or mean; spread_by: stdev or mad (scaled), times the factor. lower: derive, zero (not below 0 if the band was not) or keep (the band's own if the centre is above it)."""
    factor = F.lit(k) if k is not None else F.element_at(F.create_map(*(F.lit(x) for kv in TOLERANCE.items() for x in kv)), F.col("n").cast("int"))
    whole = lambda c: F.col(c) == F.col(c).cast("long")
    held = obs.groupBy(by).agg(
        F.median("ci_half").alias("ci"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.min("band_lo").alias("was_lo"), F.max("band_hi").alias("was_hi"),
        F.bool_and(F.col("value").between(F.col("band_lo"), F.col("band_hi"))).alias("inside"), F.bool_and(whole("value") & whole("band_lo") & whole("band_hi")).alias("units"),
    )
    name = F.col(by).cast("string")
    unit = F.when(name.endswith("_us"), F.lit(floor_us)).when(name.endswith("_ms"), F.lit(floor_ms)).otherwise(F.lit(0.0))
    s = spread(obs, by).join(held, by).withColumns({
        "middle": F.col(centre), "t_spread": factor * F.col({"stdev": "sd", "mad": "mad"}[spread_by]), "t_ci": F.coalesce(F.col("ci"), F.lit(0.0)) * F.lit(float(ci_factor)), "t_relative": F.abs(centre) * F.lit(float(relative)), "t_floor": unit})
    terms = {"k*stddev" if spread_by == "stdev" else "k*mad": "t_spread", "ci_half": "t_ci", "relative": "t_relative", "floor": "t_floor"}
    s = s.withColumn("half", F.greatest(*terms.values()))
    why = (
        F.when(name.isin([*keep]), "declared").when(F.col("inside"), "in-band").when(F.col("units"), "quantised").when(F.col("t_spread").isNull(), "no-factor")
        .when(F.col("half") == 0, "no-width").otherwise("derived")
    )
    binding = None
    for term, column in terms.items():
        binding = F.when(F.col(column) == F.col("half"), term) if binding is None else binding.when(F.col(column) == F.col("half"), term)
    low = F.col("middle") - F.col("half")
    applies = {"derive": F.lit(False), "zero": F.col("was_lo") >= 0, "keep": F.col("middle") > F.col("was_lo")}[lower]
    bounded = F.when(applies, F.greatest(low, F.lit(0.0)) if lower == "zero" else F.col("was_lo")).otherwise(low)
    s = s.withColumns({"why": why, "new_lo": outward(bounded, False), "new_hi": outward(F.col("middle") + F.col("half"), True)})
    derived, stays = F.col("why") == "derived", F.col("why").isin("declared", "in-band")
    return s.select(
        by, "n", F.col("middle").alias("centre"), "why", F.when(derived, F.col("half")).alias("half_width"), F.when(derived, binding).alias("binding"),
        F.when(derived, F.when(applies, lower).otherwise("derive")).alias("lower_policy"),
        F.when(derived, F.col("new_lo")).when(stays, F.col("was_lo")).alias("lo"), F.when(derived, F.col("new_hi")).when(stays, F.col("was_hi")).alias("hi"),
        F.when(derived, (F.col("lowest") >= F.col("new_lo")) & (F.col("highest") <= F.col("new_hi"))).alias("holds_own"),
    )
