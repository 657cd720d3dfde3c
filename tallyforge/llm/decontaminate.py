"""Benchmark decontamination with a distributed positional inverted index.

The index holds (term, document row, position) of every training token that some benchmark item
uses, written in segments: each scan task sorts its own postings by term, so that readers of a few
terms pass over most row groups, and nothing is shuffled to build it. A document's end is a posting
of term 0, whose position is the number of words. Searches start at the rarest terms.

Equal windows of many items (boilerplate) are searched once, as the window of the least item that has them;
the items of a window are attached to its hits at the end.

Phrases: each such window lists its two rarest places, their postings less the terms' offsets are
where the item may stand, places met by two such terms are intersected with the postings of all the
item's other terms, and runs of matched offsets as long as a window are exact hits.

Proximity: a window's terms, in any order, within SPAN consecutive words. Postings of its two rarest
terms that are nearer than that are found by blocks of SPAN words, and only there are the postings of
its other terms read; so a frequent term is never paired with others.

Defined cases: null texts have no words; very long texts are searched whole; items without words match
nothing; rows are judged one by one, so repeated rows and doc_ids each give a row; items of one item_id
count once, and a null item_id reads as an empty string; equally rare terms are taken by place, or by
number; empty documents or benchmark give empty or all-clean results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import ascii_lower, n_rows, planned_once, shared_dir, stash, together

WINDOW = 13
#: Consecutive words that hold all terms of a window in a proximity match.
SPAN = 20
#: Parts into which the postings of a term are dealt where its other side is too large to broadcast.
SALTS = 16
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a side that is broadcast, by a count taken first (at most about 50 bytes each); larger sides are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Words of all items up to which what is made of the benchmark alone (at most WINDOW rows a word) is made in one task.
FEW_WORDS = 50_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def sized(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has few rows."""
    return F.broadcast(df) if n_rows(df) <= BROADCAST_ROWS else df


def join_terms(index: DataFrame, side: DataFrame) -> DataFrame:
    """index joined with side on term; a side that is not broadcast is laid out SALTS times, so that no term's postings meet in one task."""
    if n_rows(side) <= BROADCAST_ROWS:
        return index.join(F.broadcast(side), "term")
    dealt = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return index.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS)).cast("int")).join(dealt, ["term", "salt"]).drop("salt")


class Items:
    """The benchmark's terms: item (a number), offset and term number; as many rows as the benchmark has words."""

    def __init__(self, benchmark: DataFrame, where: str) -> None:
        texts = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("words"))
        texts = texts.where(F.size("words") > 0).distinct()
        self.items = stash(texts.withColumn("item", F.monotonically_increasing_id()), f"{where}/items")
        spark = benchmark.sparkSession
        with planned_once(spark):
            n = self.items.agg(F.sum(F.size("words"))).first()[0] or 0
        self.few = n <= FEW_WORDS
        flat = together(self.items, self.few).select("item", F.size("words").alias("len"), F.posexplode("words").alias("off", "word"))
        terms = flat.select("word").distinct()
        numbered = terms.withColumn("term", F.monotonically_increasing_id() + 1)
        end = spark.createDataFrame([("", 0)], "word string, term long")
        with planned_once(spark, self.few):
            self.vocabulary = stash(together(numbered.union(end), self.few), f"{where}/vocabulary")
            self.terms = stash(flat.join(self.vocabulary, "word").select("item", "len", "off", "term"), f"{where}/terms")


def build_index(docs: DataFrame, vocabulary: DataFrame, where: str) -> DataFrame:
    """The postings: term, row, pos, and doc_id on the posting of a document's end."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_append(words(F.col("text")), "").alias("words"))
    flat = rows.select("row", "doc_id", F.posexplode("words").alias("pos", "word"))
    found = flat.join(sized(vocabulary), "word").select("term", "row", "pos", F.when(F.col("term") == 0, F.col("doc_id")).alias("doc_id"))
    return stash(found.sortWithinPartitions("term", "row", "pos"), f"{where}/index")


def window_terms(terms: DataFrame, index: DataFrame, where: str, window: int = WINDOW) -> DataFrame:
    """item, start, len, off, term and often (its postings) of every window of every item."""
    often = index.where("term > 0").groupBy("term").agg(F.count("*").alias("often"))
    rated = terms.join(often, "term", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    starts = F.sequence(F.greatest(F.lit(0), F.col("off") - (window - 1)), F.least(F.col("off"), F.greatest(F.lit(0), F.col("len") - window)))
    return stash(rated.withColumn("start", F.explode(starts)), f"{where}/windows")


def shared_windows(windows: DataFrame, ordered: bool, where: str, few: bool) -> DataFrame:
    """item, start, own_item and own_start: of the windows with the same terms, in order or as a set, the least one stands for all."""
    terms = F.transform(F.array_sort(F.collect_list(F.struct("off", "term"))), lambda x: x["term"]) if ordered else F.array_sort(F.collect_set("term"))
    with planned_once(windows.sparkSession, few):
        keyed = stash(together(windows, few).groupBy("item", "start").agg(F.array_join(terms.cast("array<string>"), " ").alias("key")), f"{where}-keys")
        keyed = together(keyed, few)
        own = keyed.groupBy("key").agg(F.min(F.struct("item", "start")).alias("own"))
        return stash(keyed.join(own, "key").select("item", "start", F.col("own.item").alias("own_item"), F.col("own.start").alias("own_start")), where)


def owners(same: DataFrame) -> DataFrame:
    """The windows that stand for themselves: item and start."""
    return same.where("item = own_item and start = own_start").select("item", "start")


def items_of(found: DataFrame, same: DataFrame, items: DataFrame) -> DataFrame:
    """row and item_id of row, item and start of found windows, whichever equal one was found."""
    own = same.select("item", "start", "own_item", "own_start")
    side = F.broadcast if n_rows(own) <= BROADCAST_ROWS else lambda df: df
    groups = found.join(side(own), ["item", "start"]).select("row", "own_item", "own_start").distinct()
    members = own.select("own_item", "own_start", F.col("item").alias("member")).distinct()
    named = groups.join(side(members), ["own_item", "own_start"]).select("row", F.col("member").alias("item")).distinct()
    return named.join(sized(items), "item").select("row", "item_id").distinct()


def rare_offsets(windows: DataFrame) -> DataFrame:
    """Of each window that can occur, its two rarest offsets: item, off, term, need."""
    w = Window.partitionBy("item", "start")
    ranked = windows.withColumn("rank", F.row_number().over(w.orderBy("often", "off"))).withColumn("least", F.min("often").over(w))
    return ranked.where("rank <= 2 and least > 0").select("item", "off", "term", F.least(F.lit(2), F.col("len")).alias("need")).distinct()


def phrase_hits(items: Items, windows: DataFrame, index: DataFrame, where: str, window: int = WINDOW) -> DataFrame:
    """Exact hits: row, item, first (the run's first word in the item), start, n_words and len of every longest run of an item's words that holds a
    window, for the items whose windows stand for all equal ones."""
    with planned_once(index.sparkSession, items.few):
        rare = stash(rare_offsets(together(windows, items.few)), f"{where}/rare")
    at = join_terms(index.where("term > 0"), rare).select("row", "item", (F.col("pos") - F.col("off")).alias("shift"), "off", "need")
    met = at.groupBy("row", "item", "shift").agg(F.array_sort(F.collect_set("off")).alias("offs"), F.max("need").alias("need"))
    close = F.exists(
        F.sequence(F.lit(1), F.size("offs")),
        lambda i: (F.size("offs") >= F.col("need")) & ((F.col("need") == 1) | ((i > 1) & (F.element_at("offs", i) - F.element_at("offs", F.greatest(i - 1, F.lit(1))) < window))),
    )
    places = stash(met.where(close).select("row", "item", "shift"), f"{where}/places")
    wanted = places.join(sized(items.terms), "item").select("row", "item", "shift", "len", "off", "term", (F.col("shift") + F.col("off")).alias("pos"))
    near = index.where("term > 0").select("row", "pos", "term").join(sized(places.select("row").distinct()), "row", "left_semi")
    matched = wanted.join(near, ["row", "pos", "term"]).select("row", "item", "shift", "len", "off")
    run = F.col("off") - F.row_number().over(Window.partitionBy("row", "item", "shift").orderBy("off"))
    runs = matched.withColumn("run", run).groupBy("row", "item", "shift", "run").agg(F.min("off").alias("first"), F.count("*").alias("n"), F.max("len").alias("len"))
    hits = runs.where(F.col("n") >= F.least(F.lit(window), F.col("len")))
    return stash(hits.select("row", "item", "first", (F.col("shift") + F.col("first")).alias("start"), F.col("n").alias("n_words"), "len"), f"{where}/hits")


def proximity_matches(items: Items, windows: DataFrame, index: DataFrame, where: str, span: int = SPAN) -> DataFrame:
    """row and item_id of every item that has a window whose terms all stand, in any order, within `span` words of the document."""
    block = lambda pos: F.floor(pos / span)
    around = lambda pos: F.explode(F.sequence(block(pos) - 1, block(pos) + 1))
    same = shared_windows(windows, False, f"{where}/same-sets", items.few)
    wanted = windows.join(owners(same), ["item", "start"], "left_semi").select("item", "start", "term", "often").distinct()
    w = Window.partitionBy("item", "start")
    ranked = wanted.withColumn("rank", F.row_number().over(w.orderBy("often", "term"))).withColumn("least", F.min("often").over(w)).where("least > 0")
    first, second = (F.max(F.when(F.col("rank") == k, F.col("term"))) for k in (1, 2))
    rarest = stash(ranked.groupBy("item", "start").agg(first.alias("t1"), F.coalesce(second, F.lit(0)).alias("t2"), F.count("*").alias("need")), f"{where}/rarest")
    pairs = stash(rarest.select("t1", "t2").distinct(), f"{where}/pairs")
    postings = index.where("term > 0").select("row", "pos", "term")
    at = join_terms(postings, pairs.withColumnRenamed("t1", "term")).select("row", "pos", F.col("term").alias("t1"), "t2")
    other = join_terms(postings, pairs.where("t2 > 0").select(F.col("t2").alias("term")).distinct()).select("row", F.col("term").alias("t2"), F.col("pos").alias("pos2"), around(F.col("pos")).alias("block"))
    close = at.where("t2 > 0").withColumn("block", block(F.col("pos"))).join(other, ["row", "t2", "block"]).where(F.abs(F.col("pos") - F.col("pos2")) < span)
    met = stash(close.select("row", "pos", "t1", "t2").union(at.where("t2 = 0").select("row", "pos", "t1", "t2")).distinct(), f"{where}/met")
    places = stash(met.join(sized(rarest), ["t1", "t2"]).select("row", "item", "start", "need", "pos"), f"{where}/near-places")
    near = postings.join(sized(places.select("row").distinct()), "row", "left_semi").select("row", "term", F.col("pos").alias("at"), around(F.col("pos")).alias("block"))
    asked = places.join(sized(stash(wanted, f"{where}/wanted")), ["item", "start"]).withColumn("block", block(F.col("pos")))
    found = asked.join(near, ["row", "term", "block"]).where(F.abs(F.col("pos") - F.col("at")) < span)
    # at most 2 span - 1 words lie around a place
    seen = found.groupBy("row", "item", "start", "pos").agg(F.max("need").alias("need"), F.collect_set(F.struct("at", "term")).alias("seen"))
    within = lambda x: F.filter("seen", lambda y: (y["at"] >= x["at"]) & (y["at"] < x["at"] + span))
    full = F.exists("seen", lambda x: F.size(F.array_distinct(F.transform(within(x), lambda y: y["term"]))) >= F.col("need"))
    good = stash(seen.where(full).select("row", "item", "start").distinct(), f"{where}/near-hits")
    return items_of(good, same, items.items.select("item", "item_id"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int | None = SPAN, where: str | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document, and n_near, the items with a
    proximity match (without span, no proximity is searched and n_near is null). where: a folder for the index and other tables, which the result reads."""
    where = where or shared_dir(docs.sparkSession)
    items = Items(benchmark, where)
    index = build_index(docs, items.vocabulary, where)
    windows = window_terms(items.terms, index, where, window)
    same = shared_windows(windows, True, f"{where}/same-windows", items.few)
    hits = phrase_hits(items, windows.join(owners(same), ["item", "start"], "left_semi"), index, where, window)
    # words under several hits count once: each hit adds what lies beyond the furthest end before it
    before = Window.partitionBy("row").orderBy("start", "n_words").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("row", "start", "n_words").distinct()
    reach = F.coalesce(F.max(F.col("start") + F.col("n_words")).over(before), F.lit(0))
    added = spans.select("row", F.greatest(F.lit(0), F.col("start") + F.col("n_words") - F.greatest(F.col("start"), reach)).alias("added"))
    n_hit = added.groupBy("row").agg(F.sum("added").alias("n_hit"))
    inside = F.sequence(F.col("first"), (F.col("first") + F.col("n_words") - F.least(F.lit(window), F.col("len"))).cast("int"))
    held = hits.select("row", "item", F.explode(inside).alias("start"))
    by_item = items_of(held, same, items.items.select("item", "item_id")).groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    found = n_hit.join(by_item, "row")
    if span is not None:
        near = proximity_matches(items, windows, index, where, span).groupBy("row").agg(F.count("*").alias("n_near"))
        found = found.join(near, "row", "full")
    ends = index.where("term = 0").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("ids", F.array().cast("array<string>"))
    n_near = F.lit(None).cast("long") if span is None else F.coalesce("n_near", F.lit(0)).cast("long")
    return ends.join(found, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), n_near.alias("n_near"),
    )
