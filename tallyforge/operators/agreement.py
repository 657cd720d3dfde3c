"""Agreement of two raters: contingency, kappa with a clustered jackknife, proportions with intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.stats import interval, kappa, wilson, z_for
from tallyforge.session import written


def contingency(df: DataFrame, first: str, second: str, categories: list[str], cluster: str | None = None) -> DataFrame:
    """AG-01: first, second, n over all pairs of the vocabulary (and by cluster, without empty cells). Values outside it raise."""
    known = F.col(first).isin(categories) & F.col(second).isin(categories)
    checked = df.where(F.assert_true(known, F.lit("a category is outside the vocabulary")).isNull())
    if cluster is not None:
        return checked.groupBy(F.col(cluster).alias("cluster"), F.col(first).alias("first"), F.col(second).alias("second")).agg(F.count("*").alias("n"))
    one = lambda name: df.sparkSession.createDataFrame([(c,) for c in categories], f"{name} string")
    grid = one("first").crossJoin(one("second"))  # the vocabulary squared, whatever the data
    counts = checked.groupBy(F.col(first).alias("first"), F.col(second).alias("second")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["first", "second"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def _sums(first: str, second: str, categories: list[str]) -> list[Column]:
    hit = lambda c: F.count_if(c)
    return (
        [F.count("*").alias("n"), hit(F.col(first) == F.col(second)).alias("same")]
        + [hit(F.col(first) == c).alias(f"f{i}") for i, c in enumerate(categories)]
        + [hit(F.col(second) == c).alias(f"s{i}") for i, c in enumerate(categories)]
    )


def _kappa_of(n: Column, same: Column, f: list[Column], s: list[Column]) -> tuple[Column, Column, Column]:
    p_o = F.try_divide(same.cast("double"), n)
    p_e = F.try_divide(sum((a * b for a, b in zip(f, s, strict=True)), F.lit(0)).cast("double"), n * n)
    return p_o, p_e, kappa(p_o, p_e)


def agreement(df: DataFrame, first: str, second: str, cluster: str, categories: list[str], alpha: float = 0.05) -> DataFrame:
    """AG-02, AG-03: one row: n, p_o, p_e, kappa, pabak, clusters and the jackknife interval of kappa.

    One pass counts by cluster; each replicate is the total less one cluster."""
    k = len(categories)
    known = F.col(first).isin(categories) & F.col(second).isin(categories)
    by = df.where(F.assert_true(known, F.lit("a category is outside the vocabulary")).isNull()).groupBy(cluster).agg(*_sums(first, second, categories))
    names = ["n", "same"] + [f"f{i}" for i in range(k)] + [f"s{i}" for i in range(k)]
    total = by.agg(*(F.sum(x).alias(f"t_{x}") for x in names), F.count("*").alias("clusters"))
    cols = lambda p: (F.col(f"{p}n"), F.col(f"{p}same"), [F.col(f"{p}f{i}") for i in range(k)], [F.col(f"{p}s{i}") for i in range(k)])
    less = by.crossJoin(F.broadcast(total)).select(*((F.col(f"t_{x}") - F.col(x)).alias(x) for x in names))  # total is one row
    replicate = less.select(_kappa_of(*cols(""))[2].alias("r"), F.col("n").alias("left"))
    spread = replicate.agg(F.var_pop("r").alias("v"), F.count("r").alias("g_ok"), F.count("*").alias("g"))
    p_o, p_e, kap = _kappa_of(*cols("t_"))
    half = F.lit(z_for(alpha)) * F.sqrt(F.col("v") * (F.col("g") - 1))
    ok = (F.col("g") >= 2) & (F.col("g_ok") == F.col("g"))
    out = total.crossJoin(F.broadcast(spread)).select(
        F.col("t_n").alias("n"), "clusters", p_o.alias("p_o"), p_e.alias("p_e"), kap.alias("kappa"),
        ((k * p_o - 1) / (k - 1)).alias("pabak"),
        F.when(ok, F.greatest(F.lit(-1.0), kap - half)).alias("kappa_lo"), F.when(ok, F.least(F.lit(1.0), kap + half)).alias("kappa_hi"),
    )
    return out


def agreement_by(df: DataFrame, by: list[str], first: str, second: str, cluster: str, categories: list[str], alpha: float = 0.05) -> DataFrame:
    """AG-02, AG-03 of every group: n, clusters, p_o, p_e, kappa and its interval. Rows of one group and cluster are summed
    before anything is joined; the groups are few (tables of one report), the clusters need not be. Rows with a null side are left out."""
    known = F.coalesce(F.col(first).isin(categories) & F.col(second).isin(categories), F.lit(True))  # nulls may be met before the filter
    checked = df.where(F.assert_true(known, F.lit("a category is outside the vocabulary")).isNull()).where(F.col(first).isNotNull() & F.col(second).isNotNull())
    sums = checked.groupBy(*by, F.col(cluster).alias("_cluster")).agg(*_sums(first, second, categories))
    names = ["n", "same", *(f"{side}{i}" for side in "fs" for i in range(len(categories)))]
    cols = lambda p: (F.col(f"{p}n"), F.col(f"{p}same"), *([F.col(f"{p}{side}{i}") for i in range(len(categories))] for side in "fs"))
    total = sums.groupBy(*by).agg(*(F.sum(x).alias(f"t_{x}") for x in names), F.count("*").alias("clusters"))
    left = sums.join(F.broadcast(total), by).select(*by, *((F.col(f"t_{x}") - F.col(x)).alias(x) for x in names))
    spread = left.select(*by, _kappa_of(*cols(""))[2].alias("r")).groupBy(*by).agg(F.var_pop("r").alias("v"), F.count("r").alias("g_ok"))
    p_o, p_e, kap = _kappa_of(*cols("t_"))
    half = F.lit(z_for(alpha)) * F.sqrt(F.col("v") * (F.col("clusters") - 1))
    ok = (F.col("clusters") >= 2) & (F.col("g_ok") == F.col("clusters"))
    return total.join(F.broadcast(spread), by).select(
        *by, F.col("t_n").alias("n"), "clusters", p_o.alias("p_o"), p_e.alias("p_e"), kap.alias("kappa"),
        F.when(ok, F.greatest(F.lit(-1.0), kap - half)).alias("kappa_lo"), F.when(ok, F.least(F.lit(1.0), kap + half)).alias("kappa_hi"),
    )


def clustered_proportion(df: DataFrame, hit: Column, cluster: str, alpha: float = 0.05) -> DataFrame:
    """AG-04: successes, trials, rate and the leave-one-cluster-out interval; null under two clusters."""
    by = df.groupBy(cluster).agg(F.count_if(hit).alias("s"), F.count(hit).alias("n")).where("n > 0")
    total = by.agg(F.sum("s").alias("successes"), F.sum("n").alias("trials"), F.count("*").alias("g"))
    left = by.crossJoin(F.broadcast(total)).select(((F.col("successes") - F.col("s")) / F.nullif(F.col("trials") - F.col("n"), F.lit(0))).alias("r"))
    spread = left.agg(F.var_pop("r").alias("v"))
    rate, half = F.col("successes") / F.col("trials"), F.lit(z_for(alpha)) * F.sqrt(F.col("v") * (F.col("g") - 1))
    band = F.when(F.col("g") >= 2, interval(F.greatest(F.lit(0.0), rate - half), F.least(F.lit(1.0), rate + half)))
    return total.crossJoin(F.broadcast(spread)).select("successes", "trials", rate.alias("rate"), band["lo"].alias("lo"), band["hi"].alias("hi"))


def proportions(df: DataFrame, by: str, hit: Column, alpha: float = 0.05) -> DataFrame:
    """AG-05: rate and Wilson interval of each group."""
    out = df.groupBy(by).agg(F.count_if(hit).alias("successes"), F.count("*").alias("trials"))
    w = wilson(F.col("successes"), F.col("trials"), alpha)
    return out.select(by, "successes", "trials", (F.col("successes") / F.col("trials")).alias("rate"), w["lo"].alias("lo"), w["hi"].alias("hi"))


#: Raters of the first pass, whose pairs with all others are counted by item; it gives the bound for the search of the rest.
BLOCK = 32
BROADCAST_ITEMS, SALTS = 20_000, 16
#: Items of more raters than this, the largest MASKED of them, are bits of a rater's mask; pairs are not made by them.
HOT_ITEM, MASKED = 1000, 12
#: Pairs of raters on an item that one task counts.
PAIRS_A_TASK = 2_000_000


def first_labels(labels: DataFrame, rater: str, item: str, choice: str, order: str) -> DataFrame:
    """rater, item and choice of the first label of every rater and item."""
    return labels.groupBy(F.col(rater).alias("rater"), F.col(item).alias("item")).agg(F.min_by(choice, order).alias("choice"))


def with_items(rows: DataFrame, by_item: DataFrame) -> DataFrame:
    """rows joined with a written table of items: broadcast if it is small (an item may take BLOCK names), else dealt over SALTS parts, so that
    the rows of one item never meet in one task."""
    if by_item.count() <= BROADCAST_ITEMS:
        return rows.join(F.broadcast(by_item), "item")
    dealt = by_item.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("rater"), F.lit(SALTS)).cast("int")).join(dealt, ["item", "_salt"]).drop("_salt")


def most_shared_pair(given: DataFrame, block: int = BLOCK) -> DataFrame:
    """JN-06, OR-03: rater_a, rater_b (in order) and shared, of the two raters with most items in common; the first pair wins ties.

    given: first_labels. A pair shares no more items than either rater has. The raters with most items, `block` of them, are
    counted with all others in one pass, by item; then raters with fewer items than the best pair shares cannot win, and the pairs of
    the others are counted at once (pairs_of_rest)."""
    rows = written(given.select("rater", "item"))
    sizes = written(rows.groupBy("rater").agg(F.count("*").alias("n")))
    head = [r[0] for r in sizes.orderBy(F.desc("n"), "rater").limit(block).select("rater").collect()]
    names = rows.sparkSession.createDataFrame([(r,) for r in head], sizes.select("rater").schema)
    mine = rows.join(F.broadcast(names), "rater").groupBy("item").agg(F.collect_list("rater").alias("heads"))  # at most `block` raters an item
    met = with_items(rows, written(mine)).select("rater", F.explode("heads").alias("head")).where("head <> rater")
    counts = met.groupBy("rater", "head").agg(F.count("*").alias("shared")).select(F.least("rater", "head").alias("rater_a"), F.greatest("rater", "head").alias("rater_b"), "shared")
    first = lambda df: [tuple(r) for r in df.orderBy(F.desc("shared"), "rater_a", "rater_b").limit(1).collect()]
    found = first(counts)
    least = found[0][2] if found else 1
    rest = sizes.join(F.broadcast(names), "rater", "left_anti").where(F.col("n") >= least).select("rater")
    for pairs in pairs_of_rest(written(rows.join(rest, "rater", "left_semi")), least):
        found += first(pairs)
    best = sorted(found, key=lambda p: (-p[2], p[0], p[1]))[:1]
    kind = sizes.schema["rater"].dataType.simpleString()
    return rows.sparkSession.createDataFrame(best, f"rater_a {kind}, rater_b {kind}, shared long")


def pairs_of_rest(rows: DataFrame, least: int) -> list[DataFrame]:
    """Pairs of raters that share at least one item and may share `least` or more: rater_a, rater_b, shared.

    The items that most raters have (at most MASKED) are bits of each rater's mask. Pairs that share another item are counted by
    it: an item's raters go to each of them as one list, lists of one rater meet in a task, and only pairs that reach the bound
    with their masks leave it. Pairs that share masked items alone are those of two masks, of which there are at most
    2^MASKED: of two masks the least raters are named. Should they share other items as well, the first table has them
    with more, so the greatest count is exact, and so is the first pair that has it."""
    sizes = written(rows.groupBy("item").agg(F.count("*").alias("d")))
    hot = [r[0] for r in sizes.where(F.col("d") > HOT_ITEM).orderBy(F.desc("d"), "item").limit(MASKED).collect()]
    spark, kind = rows.sparkSession, rows.schema["item"].dataType.simpleString()
    bits = F.broadcast(spark.createDataFrame([(x, 1 << k) for k, x in enumerate(hot)], f"item {kind}, bit int"))
    masks = written(rows.join(bits, "item").groupBy("rater").agg(F.sum("bit").cast("int").alias("mask")))
    most = masks.agg(F.max(F.bit_count("mask"))).first()[0] or 0
    light = rows.join(bits.select("item"), "item", "left_anti")
    pairs = sizes.join(bits.select("item"), "item", "left_anti").agg(F.sum(F.col("d") * (F.col("d") - 1) / 2)).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, int(pairs // PAIRS_A_TASK) + 1)
    by_item = written(light.groupBy("item").agg(F.array_sort(F.collect_list("rater")).alias("raters")))
    later = F.slice("raters", F.array_position("raters", F.col("rater")).cast("int") + 1, F.size("raters"))  # an item has a rater once
    lists = light.join(by_item, "item").select("rater", later.alias("others")).where(F.size("others") > 0)
    met = lists.repartition(tasks, "rater").select(F.col("rater").alias("rater_a"), F.explode("others").alias("rater_b"))
    counted = met.groupBy("rater_a", "rater_b").agg(F.count("*").alias("light")).where(F.col("light") + most >= least)
    mask_of = lambda c: masks.select(F.col("rater").alias(c), F.col("mask").alias(f"mask_{c[-1]}"))
    masked = counted.join(mask_of("rater_a"), "rater_a", "left").join(mask_of("rater_b"), "rater_b", "left")
    total = F.col("light") + F.coalesce(F.bit_count(F.col("mask_a").bitwiseAND(F.col("mask_b"))), F.lit(0))
    named = masks.groupBy("mask").agg(F.min("rater").alias("r"))
    second = masks.join(named, "mask").where("rater > r").groupBy("mask").agg(F.min("rater").alias("r2"), F.first("r").alias("r"))
    x, y = (named.select(F.col("mask").alias(f"mask_{s}"), F.col("r").alias(f"r_{s}")) for s in "xy")
    shared = F.bit_count(F.col("mask_x").bitwiseAND(F.col("mask_y")))
    across = x.crossJoin(y).where("mask_x < mask_y").select(F.least("r_x", "r_y").alias("rater_a"), F.greatest("r_x", "r_y").alias("rater_b"), shared.cast("long").alias("shared"))
    within = second.select(F.col("r").alias("rater_a"), F.col("r2").alias("rater_b"), F.bit_count("mask").cast("long").alias("shared"))
    return [masked.select("rater_a", "rater_b", total.cast("long").alias("shared")), across.union(within).where("shared > 0")]


def human_agreement(labels: DataFrame, rater: str, item: str, choice: str, order: str, categories: list[str], alpha: float = 0.05) -> DataFrame:
    """JN-06: the pair of raters that share most items and their agreement over them: both names, and agreement() with items as clusters.
    A rater's first label of an item counts. Without a pair there is no row."""
    given = written(first_labels(labels, rater, item, choice, order))
    pair = most_shared_pair(given)
    side = lambda end, c: given.join(F.broadcast(pair.select(F.col(end).alias("rater"))), "rater").select("item", F.col("choice").alias(c))
    both = side("rater_a", "first").join(side("rater_b", "second"), "item")
    found = agreement(both, "first", "second", "item", categories, alpha)
    return pair.select("rater_a", "rater_b").crossJoin(found)  # one row each


def coverage(df: DataFrame, row: str, part: str, decided: Column) -> DataFrame:
    """AG-18: decided counts pooled and by part, as two grouping sets."""
    g = df.withColumn("_hit", decided.cast("int")).groupingSets([[row], [part, row]], part, row)
    return g.agg(F.count("*").alias("n"), F.sum("_hit").alias("decided"))


# How the coverage table names what a run was.
AGREES, DIFFERS, UNSTATED = "selected_agrees", "selected_differs", "unstated"


def coverage_table(runs: DataFrame, references: DataFrame, abstain: str = "abstain") -> DataFrame:
    """AG-18: seed (null: all seeds), outcome, gold_decided and gold_tie: runs by what they were and what people said of their item; with
    runs, ungolded (of items nobody judged; in no row) and abstained_on_decided of the whole table beside every row.

    runs: item, seed, outcome, category, reason. references: item, category. A run that was measured agrees, differs, or has
    no candidate for the reason it states; another is its outcome."""
    gold = references.select("item", F.col("category").alias("gold"))
    known = runs.join(gold, "item", "left")
    stated = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(UNSTATED))
    row = (
        F.when(F.col("outcome") == "selected", F.when(F.col("category") == F.col("gold"), AGREES).otherwise(DIFFERS))
        .when(F.col("outcome") == "no_candidate", stated(F.col("reason"))).otherwise(stated(F.col("outcome")))
    )
    lost = F.col("gold").isNotNull() & (F.col("gold") != abstain) & (F.col("outcome") == "no_candidate")
    marked = known.select("seed", F.when(F.col("gold").isNotNull(), row).alias("row"), F.col("gold").isNull().cast("int").alias("none"), (F.col("gold") == abstain).alias("tie"), lost.alias("lost"))
    both = marked.withColumn("table", F.explode(F.array(F.lit("all"), F.lit("seed")))).withColumn("seed", F.when(F.col("table") == "seed", F.col("seed")))
    cells = both.where("row is not null").groupBy("table", "seed", F.col("row").alias("outcome")).agg(F.count_if(~F.col("tie")).alias("gold_decided"), F.count_if("tie").alias("gold_tie"))
    totals = both.groupBy("table", "seed").agg(F.count_if(F.col("none") == 0).alias("runs"), F.count_if(F.col("none") == 1).alias("ungolded"), F.count_if("lost").alias("abstained_on_decided"))
    joined = totals.alias("t").join(cells.alias("c"), (F.col("t.table") == F.col("c.table")) & F.col("t.seed").eqNullSafe(F.col("c.seed")), "left")
    return joined.select("t.seed", "c.outcome", F.coalesce("c.gold_decided", F.lit(0)).alias("gold_decided"), F.coalesce("c.gold_tie", F.lit(0)).alias("gold_tie"), "t.runs", "t.ungolded", "t.abstained_on_decided")


def repeats(df: DataFrame, item: str, order: list[str], value: str) -> DataFrame:
    """WN-08: each later value of an item beside its first."""
    w = Window.partitionBy(item).orderBy(*order)
    first = df.select(item, value, F.first(value).over(w).alias("first"), F.row_number().over(w).alias("rn"))
    return first.where("rn > 1").select(item, "rn", "first", F.col(value).alias("later"))
