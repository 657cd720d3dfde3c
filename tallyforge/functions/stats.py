"""Statistics as Column expressions; constants of a level are computed once on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_for(alpha: float) -> float:
    """The two-sided normal quantile; infinite at 0 and 0 at 1."""
    return math.inf if alpha <= 0 else 0.0 if alpha >= 1 else NormalDist().inv_cdf(1 - alpha / 2)


def interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def wilson(successes: Column, trials: Column, alpha: float = 0.05) -> Column:
    """Score interval; [0, 1] without trials."""
    z, n = z_for(alpha), trials.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    base = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / base, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    inner = interval(F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half))
    return F.when(trials > 0, inner).otherwise(interval(F.lit(0.0), F.lit(1.0)))


def empirical_bernstein(n: Column, mean: Column, variance: Column, lower: float, upper: float, alpha: float = 0.05) -> Column:
    """Maurer and Pontil's bound on a mean with support [lower, upper]; null under two values."""
    log = math.log(4 / alpha)
    half = F.sqrt(2 * variance * log / n) + 7 * (upper - lower) * log / (3 * (n - 1))
    return F.when(n >= 2, interval(F.greatest(F.lit(lower), mean - half), F.least(F.lit(upper), mean + half)))


def log_gamma(x: Column) -> Column:
    """ln gamma(x), x > 0: Stirling's series at x + 10, less the ten factors between; good to about 1e-14 of its value."""
    x = x.cast("double")
    y, factors = x + 10, x
    for k in range(1, 10):
        factors = factors * (x + k)
    series = sum(c / F.pow(y, F.lit(n)) for n, c in ((1, 1 / 12), (3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680), (9, 1 / 1188)))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(factors)


def log_beta(a: Column, b: Column) -> Column:
    """ln B(a, b)."""
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def log_prior(prior: float) -> float:
    return 2 * math.lgamma(prior) - math.lgamma(2 * prior)


def log_e_at(b: Column, c: Column, theta: Column, prior: float = 1) -> Column:
    """SC-16: ln of the mixture e-value of b wins and c losses against success probability theta; Beta(prior, prior), any prior above 0."""
    win = F.when(b > 0, b * F.ln(theta)).otherwise(0.0)
    loss = F.when(c > 0, c * F.ln(1 - theta)).otherwise(0.0)
    return log_beta(b + prior, c + prior) - log_prior(prior) - win - loss


def log_e(b: Column, c: Column, prior: float = 1) -> Column:
    return log_e_at(b, c, F.lit(0.5), prior)


def theta_cs(b: Column, c: Column, alpha: float = 0.05, prior: float = 1, rounds: int = 60) -> Column:
    """Confidence sequence of theta: where the e-value stays under 1 / alpha, by bisection on each side of b / (b + c)."""
    bound, n = math.log(1 / alpha), b + c
    start = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.try_divide(b.cast("double"), n.cast("double"))))
    steps = F.sequence(F.lit(1), F.lit(rounds))
    fixed = log_beta(b + prior, c + prior) - log_prior(prior)

    def side(outer: float) -> Column:
        def step(s: Column, _: Column) -> Column:
            mid = (s["inside"] + s["outside"]) / 2
            e = s["fixed"] - F.when(b > 0, b * F.ln(mid)).otherwise(0.0) - F.when(c > 0, c * F.ln(1 - mid)).otherwise(0.0)
            return F.struct(F.when(e < bound, mid).otherwise(s["inside"]).alias("inside"), F.when(e < bound, s["outside"]).otherwise(mid).alias("outside"), s["fixed"].alias("fixed"))

        first = F.struct(start.alias("inside"), F.lit(outer).alias("outside"), fixed.alias("fixed"))  # fixed is computed once, not in each step
        return F.aggregate(steps, first, step, lambda s: (s["inside"] + s["outside"]) / 2)

    lo = F.when(b > 0, side(0.0)).otherwise(0.0)
    hi = F.when(c > 0, side(1.0)).otherwise(1.0)
    return F.when(n > 0, interval(lo, hi)).otherwise(interval(F.lit(0.0), F.lit(1.0)))


def delta_cs(b: Column, c: Column, pairs: Column, alpha: float = 0.05) -> Column:
    """Confidence sequence of the mean difference: the range of d (2 theta - 1) over the corners of two sequences at alpha / 2.

    d is the share of pairs that differ."""
    theta, d = theta_cs(b, c, alpha / 2), theta_cs(b + c, pairs - b - c, alpha / 2)

    def over_corners(v: Column) -> Column:
        corners = [v["d"][x] * (2 * v["theta"][y] - 1) for x in ("lo", "hi") for y in ("lo", "hi")]
        return interval(F.least(*corners), F.greatest(*corners))

    return F.transform(F.array(F.struct(theta.alias("theta"), d.alias("d"))), over_corners)[0]  # each sequence stands once in the expression


def kappa(p_o: Column, p_e: Column) -> Column:
    """Cohen's kappa; null where chance agreement is complete."""
    return F.when(p_e < 1, (p_o - p_e) / (1 - p_e))


def round_or_zero(x: Column, places: int = 3) -> Column:
    """Half away from zero; 0 for what is not a number."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.round(x, places))
