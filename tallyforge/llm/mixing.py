"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed into cells of source, language and topic. Each dimension has a factor for each of
its categories; a cell's weight is its share of all tokens times its three factors. In turn a
dimension's factors are set so that its categories' weights are their targets, until the largest miss
of a round is under MISS or ROUNDS are over (as where no weights of the cells can meet all targets; then
marginals() tells what is missed). A cell table of at most BROADCAST_CELLS rows is raked in one task,
RAKES rounds a job; a larger one by grouped sums, whose partial sums are taken before the shuffle, so
neither a large category nor a long list of sources meets in one task. Every document of a cell is then
drawn with the cell's calibrated rate: as many whole copies as the rate has, and one more with the
probability that is left, against a uniform number from the MD5 of its doc_id and text. So the targets are met where a cell holds less
than is asked of it, too. Only the cell table is iterated on, never the documents.

Defined cases: null source, language or topic are categories of their own, `(none)`; null and empty
texts have no tokens, are left out of the fit and never drawn; very long texts count whole; rows of one doc_id or
of none are drawn by their texts, and repeated rows alike; targets are renewed over the categories that have tokens, and a category that given
targets do not name is not drawn; an empty table gives an empty result; extra columns pass through where
keep names them, and none of them may be named like the result's own columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import n_rows, planned_once, shared_dir, stash, together

DIMS = ("source", "lang", "topic")
#: A dimension's default target shares are its token shares to this power, scaled to 1: under 1, large categories give way.
TEMPER = {"source": 0.5, "lang": 0.6, "topic": 0.8}
#: Rounds over all dimensions in one job, and at most; the relative miss of a target at which they end (a round takes it to about a
#: tenth); expected share of all tokens that is drawn.
RAKES, ROUNDS, MISS, SHARE, SEED = 5, 40, 1e-12, 0.5, "mix"
#: Cells, or categories of a dimension, up to this number are broadcast (about 100 bytes each); more are joined by shuffle.
BROADCAST_CELLS = 50_000
NONE = "(none)"

#: Target weights of a dimension: by category, or a table of category and weight.
Targets = Mapping[str, float] | DataFrame


def default_topic(text: Column) -> Column:
    """A coarse kind of text: tables, marked-up junk, capitals, license notices, or prose."""
    return (
        F.when(text.contains(" | "), "table").when(text.contains("###") | text.contains("***"), "marked")
        .when(text.contains("!! "), "shouted").when(text.contains("icense"), "licensed").otherwise("prose")
    )


def estimated_tokens(text: Column) -> Column:
    """Four UTF-8 bytes a token, at least one for a text that is not empty."""
    return F.floor((F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 3) / 4).cast("long")


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of seed, doc_id and the text's MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def target_shares(cells: DataFrame, d: str, temper: float, given: Targets | None) -> DataFrame:
    """d and its target, over the categories that have tokens; the targets sum to 1."""
    sums = cells.groupBy(d).agg(F.sum("tokens").alias("s"))
    if given is None:
        rated = sums.select(d, F.pow(F.col("s").cast("double"), F.lit(temper)).alias("asked"))
    else:
        asked = given.toDF("category", "asked") if isinstance(given, DataFrame) else cells.sparkSession.createDataFrame([*given.items()], "category string, asked double")
        rated = sums.join(asked, F.col(d) == F.col("category"), "left").select(d, F.coalesce(F.col("asked").cast("double"), F.lit(0.0)).alias("asked"))
    whole = rated.agg(F.sum("asked")).first()[0] or 1.0
    return rated.select(d, (F.col("asked") / F.lit(whole)).alias("target"))


def rake(cells: DataFrame, where: str, temper: Mapping[str, float] = TEMPER, targets: Mapping[str, Targets] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """cells: DIMS and tokens, in a table. Adds weight, whose sums by each dimension approach the targets."""
    one_task = n_rows(cells) <= BROADCAST_CELLS
    with planned_once(cells.sparkSession, one_task):
        return raked_cells(together(cells, one_task), where, one_task, temper, targets, rounds)


def raked_cells(cells: DataFrame, where: str, one_task: bool, temper: Mapping[str, float], targets: Mapping[str, Targets] | None, rounds: int) -> DataFrame:
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    asked = {d: stash(target_shares(cells, d, temper[d], (targets or {}).get(d)), f"{where}/target-{d}") for d in DIMS}
    now = cells.withColumn("weight", F.col("tokens") / F.lit(total))
    for d in DIMS:
        small = n_rows(asked[d]) <= BROADCAST_CELLS
        now = now.join((F.broadcast(asked[d]) if small else asked[d]).withColumnRenamed("target", f"target_{d}"), d)
    now = stash(now, f"{where}/raked")

    def raked(rows: DataFrame, d: str) -> DataFrame:
        """rows with the weights of one dimension set to its targets, and miss, the largest so far of the round."""
        if one_task:
            held = rows.withColumn("held", F.sum("weight").over(Window.partitionBy(d)))
        else:
            held = stash(rows, f"{where}/before-{d}-{uuid.uuid4().hex}")
            sums = stash(held.groupBy(d).agg(F.sum("weight").alias("held")), f"{where}/held-{d}-{uuid.uuid4().hex}")
            held = held.join(F.broadcast(sums) if n_rows(sums) <= BROADCAST_CELLS else sums, d)
        target = F.col(f"target_{d}")
        miss = F.when(target > 0, F.abs(F.col("held") / target - 1)).otherwise(0.0)
        return held.withColumns({"weight": F.when(F.col("held") > 0, F.col("weight") * target / F.col("held")).otherwise(0.0), "miss": F.greatest("miss", miss)}).drop("held")

    for k in range(0, rounds, RAKES):
        now = together(now, one_task)
        for _ in range(min(RAKES, rounds - k)):
            now = now.withColumn("miss", F.lit(0.0))
            for d in DIMS:
                now = raked(now, d)
        now = stash(now, f"{where}/raked-{k}")
        if (now.agg(F.max("miss")).first()[0] or 0) < MISS:
            break
    return now.select(*DIMS, "tokens", "weight")


def marginals(drawn: DataFrame, temper: Mapping[str, float] = TEMPER, targets: Mapping[str, Targets] | None = None) -> DataFrame:
    """dimension, category, target, expected and reached: parts of the tokens drawn, by rate and in fact. drawn: as of mix()."""
    parts = None
    rows = drawn.where("n_tokens > 0").withColumn("tokens", F.col("n_tokens"))
    for d in DIMS:
        sums = rows.groupBy(d).agg(F.sum(F.col("tokens") * F.col("p")).alias("e"), F.sum(F.col("tokens") * F.col("copies")).alias("c"))
        e, c = sums.agg(F.sum("e"), F.sum("c")).first()
        got = target_shares(rows, d, temper[d], (targets or {}).get(d)).join(sums, d)
        part = got.select(F.lit(d).alias("dimension"), F.col(d).alias("category"), "target", (F.col("e") / F.lit(e or 1)).alias("expected"), (F.col("c") / F.lit(c or 1)).alias("reached"))
        parts = part if parts is None else parts.union(part)
    return parts


def mix(docs: DataFrame, topic: Column | None = None, tokens: Column | None = None, share: float = SHARE, seed: str = SEED, temper: Mapping[str, float] = TEMPER,
        targets: Mapping[str, Targets] | None = None, rounds: int = ROUNDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, source, lang, topic, n_tokens, p (the rate), copies and kept of every document.

    targets gives the weights of a dimension's categories; a dimension without any takes its token shares, tempered."""
    where = shared_dir(docs.sparkSession)
    named = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    text = F.col("text")
    rows = docs.select(
        *keep, uniform(F.col("doc_id"), text, seed).alias("_u"), named(F.col("source")).alias("_source"), named(F.col("lang")).alias("_lang"),
        named(default_topic(text) if topic is None else topic).alias("_topic"), (estimated_tokens(text) if tokens is None else tokens).alias("n_tokens"),
    )
    sums = rows.where("n_tokens > 0").groupBy(*(F.col(f"_{d}").alias(d) for d in DIMS)).agg(F.sum("n_tokens").alias("tokens"))
    cells = stash(sums, f"{where}/cells")
    with planned_once(docs.sparkSession):
        total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    rate = (F.col("weight") * F.lit(share) * F.lit(total) / F.col("tokens")).alias("rate")
    rates = stash(rake(cells, where, temper, targets, rounds).select(*(F.col(d).alias(f"_{d}") for d in DIMS), rate), f"{where}/rates")
    if n_rows(rates) <= BROADCAST_CELLS:
        rates = F.broadcast(rates)
    p = F.when(F.col("n_tokens") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0)
    joined = rows.join(rates, [f"_{d}" for d in DIMS], "left").withColumn("_p", p)
    copies = (F.floor("_p") + (F.col("_u") < F.col("_p") - F.floor("_p")).cast("long")).cast("long")
    return joined.select(
        *keep, *(F.col(f"_{d}").alias(d) for d in DIMS if d not in keep), "n_tokens", F.round("_p", 6).alias("p"), copies.alias("copies"), (copies > 0).alias("kept"),
    )


def oracle_sql() -> str:
    """mix() with its defaults over the view documents, for DuckDB: weights are raked as they stand, without factors."""
    named = lambda x: f"coalesce({x}, '{NONE}')"
    topic = (
        "CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '###') OR contains(text, '***') THEN 'marked' "
        "WHEN contains(text, '!! ') THEN 'shouted' WHEN contains(text, 'icense') THEN 'licensed' ELSE 'prose' END"
    )
    steps = []
    last = "c0"
    for k in range(ROUNDS):  # rounds after the misses are under MISS change nothing
        for d in DIMS:
            name = f"r{k}_{d}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (weight * target_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM {last})")
            last = name
    targets = ", ".join(
        f"t_{d} AS (SELECT {d}, pow(sum(tokens)::DOUBLE, {TEMPER[d]}) / sum(pow(sum(tokens)::DOUBLE, {TEMPER[d]})) OVER () AS target_{d} FROM c GROUP BY {d})" for d in DIMS
    )
    return f"""
WITH r AS MATERIALIZED (SELECT doc_id, {named("source")} AS source, {named("lang")} AS lang, {named(topic)} AS topic,
    ((coalesce(strlen(text), 0) + 3) // 4)::BIGINT AS n_tokens,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents),
c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM r WHERE n_tokens > 0 GROUP BY ALL), {targets},
c0 AS MATERIALIZED (SELECT c.*, tokens / sum(tokens) OVER () AS weight, target_source, target_lang, target_topic
    FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
{", ".join(steps)},
rates AS (SELECT source, lang, topic, weight * {SHARE} * (sum(tokens) OVER ())::DOUBLE / tokens AS rate FROM {last}),
j AS (SELECT r.*, CASE WHEN n_tokens > 0 THEN coalesce(rate, 0.0) ELSE 0.0 END AS q FROM r LEFT JOIN rates USING (source, lang, topic)),
k AS (SELECT *, floor(q)::BIGINT + CASE WHEN u < q - floor(q) THEN 1 ELSE 0 END AS copies FROM j)
SELECT doc_id, source, lang, topic, n_tokens, round(q, 6) AS p, copies::BIGINT AS copies, copies > 0 AS kept FROM k"""
