"""Pairwise votes: tallies, majorities, Condorcet triples, Bradley-Terry fits, strata and samples."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.ordering import ranked


def tallies(votes: DataFrame) -> DataFrame:
    """JN-08, AG-39, AG-40: wins of the lower and the higher name of each pair, ties, labelers and the majority ('tie' if none)."""
    low, high = F.least("first", "second"), F.greatest("first", "second")
    name = F.when(F.col("winner") == "first", F.col("first")).when(F.col("winner") == "second", F.col("second"))
    rows = votes.select("grp", low.alias("low"), high.alias("high"), name.alias("won"), "labeler")
    t = rows.groupBy("grp", "low", "high").agg(
        F.count_if(F.col("won") == F.col("low")).alias("low_wins"), F.count_if(F.col("won") == F.col("high")).alias("high_wins"),
        F.count_if(F.col("won").isNull()).alias("ties"), F.countDistinct("labeler").alias("labelers"),
    )
    better = lambda a, b: (F.col(a) > F.col(b)) & (F.col(a) >= F.col("ties"))
    win = F.when(better("low_wins", "high_wins"), F.col("low")).when(better("high_wins", "low_wins"), F.col("high")).otherwise("tie")
    return t.withColumn("majority", win)


def triples(t: DataFrame, min_judgments: int = 3) -> DataFrame:
    """JN-07, AG-41: every three systems of a group: incomplete, thin, cyclic or eligible, in that order, and the gold of those eligible.

    Systems of a group are few by the data's design; the joins are on the group and ordered names."""
    names = t.select("grp", F.col("low").alias("s")).union(t.select("grp", "high")).distinct()
    a, b, c = names.alias("a"), names.alias("b"), names.alias("c")
    three = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.s") < F.col("b.s"))).join(c, (F.col("a.grp") == F.col("c.grp")) & (F.col("b.s") < F.col("c.s")))
    three = three.select(F.col("a.grp").alias("grp"), F.col("a.s").alias("s1"), F.col("b.s").alias("s2"), F.col("c.s").alias("s3"))
    for tag, x, y in (("12", "s1", "s2"), ("13", "s1", "s3"), ("23", "s2", "s3")):
        side = t.select(F.col("grp"), F.col("low").alias(x), F.col("high").alias(y), F.col("majority").alias(f"m{tag}"), (F.col("low_wins") + F.col("high_wins") + F.col("ties")).alias(f"n{tag}"))
        three = three.join(side, ["grp", x, y], "left")
    ms = [F.col(f"m{x}") for x in ("12", "13", "23")]
    missing = ms[0].isNull() | ms[1].isNull() | ms[2].isNull()
    cyclic = (F.size(F.array_distinct(F.array(*ms))) == 3) & ~F.array_contains(F.array(*ms), "tie")
    n = F.col("n12") + F.col("n13") + F.col("n23")
    state = F.when(missing, "incomplete").when(n < min_judgments, "thin").when(cyclic, "cyclic").otherwise("eligible")
    unbeaten = [(s, F.col(p).isin(s_, "tie") & F.col(q).isin(s_, "tie")) for s, s_, p, q in (("s1", F.col("s1"), "m12", "m13"), ("s2", F.col("s2"), "m12", "m23"), ("s3", F.col("s3"), "m13", "m23"))]
    count = sum((u.cast("int") for _, u in unbeaten), F.lit(0))
    pick = F.coalesce(*(F.when(u, F.col(s)) for s, u in unbeaten))
    return three.select("grp", "s1", "s2", "s3", state.alias("state"), F.when(state == "eligible", F.when(count == 1, pick).otherwise("tie")).alias("gold"))


def derivation_stats(tr: DataFrame) -> DataFrame:
    """AG-43: triples by state, and the share of cycles among complete ones."""
    n = lambda s: F.count_if(F.col("state") == s)
    return tr.agg(F.count("*").alias("triples"), *(n(s).alias(s) for s in ("incomplete", "thin", "cyclic", "eligible")),
                  F.coalesce(F.try_divide(n("cyclic"), n("cyclic") + n("eligible") + n("thin")), F.lit(0.0)).alias("cycle_rate"))


def bradley_terry(t: DataFrame, rounds: int = 200) -> DataFrame:
    """AG-42: strengths by simultaneous minorise-maximise rounds; half a win each way on every pair, ties half each, geometric mean 1.

    One group's systems are a small matrix; groups spread over tasks."""

    def fit(groups: Iterator[pd.DataFrame]) -> pd.DataFrame:
        pdf = groups
        names = sorted(set(pdf["low"]) | set(pdf["high"]))
        at = {s: i for i, s in enumerate(names)}
        wins = np.full((len(names),) * 2, 0.5) - 0.5 * np.eye(len(names))
        for r in pdf.itertuples():
            wins[at[r.low], at[r.high]] += r.low_wins + r.ties / 2
            wins[at[r.high], at[r.low]] += r.high_wins + r.ties / 2
        games, strength = wins + wins.T, np.ones(len(names))
        for _ in range(rounds):
            strength = wins.sum(1) / (games / (strength[:, None] + strength[None])).sum(1)
            strength /= np.exp(np.log(strength).mean())
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "system": names, "strength": strength})

    kind = dict(t.dtypes)["grp"]
    return t.groupBy("grp").applyInPandas(fit, f"grp {kind}, system string, strength double")


def stratify(df: DataFrame, margin: str, key: list[str], shares: dict[str, float]) -> DataFrame:
    """WN-05: rows by falling margin (null last), then key, cut into strata of round(share * n); the last takes the rest."""
    placed, n = ranked(df, [], [F.desc_nulls_last(margin), *map(F.col, key)], place="_rank"), df.count()
    names, edge, stratum = list(shares), 0, F.lit(None).cast("string")
    for name in names[:-1]:
        edge += floor(n * shares[name] + 0.5)
        stratum = F.coalesce(stratum, F.when(F.col("_rank") <= edge, name))
    return placed.withColumn("stratum", F.coalesce(stratum, F.lit(names[-1]))).drop("_rank")


def stratified_sample(df: DataFrame, stratum: str, key: str, shares: dict[str, float], target: int, seed: str = "1") -> DataFrame:
    """WN-06: about `target` rows by strata in the order of shares: round(share * target) of each, the last taking what is left of the target, never
    more than there are; all rows where the target is none or not below their number. Within a stratum the rows of least sha2(seed | key)."""
    sizes = {r[0]: r[1] for r in df.where(F.col(stratum).isin([*shares])).groupBy(stratum).count().collect()}  # a row a stratum
    if target <= 0 or target >= sum(sizes.values()):
        return df
    quotas, taken = {}, 0
    for i, (name, share) in enumerate(shares.items()):
        want = target - taken if i == len(shares) - 1 else floor(share * target + 0.5)
        quotas[name] = min(max(want, 0), sizes.get(name, 0))
        taken += quotas[name]
    place = F.sha2(F.concat(F.lit(seed + "|"), F.col(key).cast("string")), 256)
    quota = F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col(stratum))
    return ranked(df.where(F.col(stratum).isin([*shares])), [stratum], [place], place="_rank").where(F.col("_rank") <= quota).drop("_rank")


def sample(df: DataFrame, stratum: str, key: str, quotas: dict[str, int], seed: str = "1") -> DataFrame:
    """WN-06: of each stratum the rows of least sha2(seed | key), up to its quota."""
    place = F.sha2(F.concat(F.lit(seed + "|"), F.col(key).cast("string")), 256)
    quota = F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col(stratum))
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy(place))).where(F.col("_rn") <= quota).drop("_rn")
