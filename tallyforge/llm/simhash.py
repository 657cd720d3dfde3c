"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are taken in one pass over whole texts. Equal fingerprints form one class before any
search. The 64 bits are cut into partitions that keep correlated bits together, from the
co-occurrence of bits over all classes. For each class, dynamic programming deals thresholds to the
partitions (they sum to tau - m + 1, and -1 leaves a partition out) so that the estimated number of
candidates and probes is least; every class within tau bits then agrees with it in some partition up
to that partition's threshold. Where even the best deal would meet more candidates than there are
fingerprints within tau bits, those fingerprints are probed one by one, so a class's cost is bounded
whatever the size of its buckets. Candidates are verified on all 64 bits inside the join, and linked
classes get components by alternating large-star and small-star rounds.

Defined cases: null texts and texts without a word have fingerprint zero; a text of one or two words
has one shingle, all its words; repeated rows and doc_ids each give a row; null doc_ids pass through
and never name a component unless all its doc_ids are null; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, product
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import BROADCAST_ROWS, in_arrow, n_rows, planned_once, shared_dir, stash, together, utf8

BITS, TAU, SEED, SHINGLE = 64, 2, 42, 3
U = np.uint64


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 hashes; as a signed 64-bit number."""
    import xxhash

    words = utf8(text).lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(s, SEED) for s in shingles), "<u8")
    votes = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 65536)):
        votes += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "fp": pa.array(fps, pa.int64())})

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8), bitorder="little").reshape(-1, BITS)


def bit_statistics(classes: DataFrame) -> np.ndarray:
    """How many classes have both bits set, for each pair of bits, over all classes (64 x 64, summed on Spark)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = bits_of(batch.column("fp").to_numpy(zero_copy_only=False)).astype(np.float64)
        both = (x.T @ x).astype(np.int64).ravel()
        return pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(BITS * BITS)), "n": pa.array(both)})

    rows = in_arrow(classes.select("fp"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for cell, n in rows:
        out[cell] = n
    return out.reshape(BITS, BITS)


def partition_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of near equal width; each starts at the least bit left and takes the bits most correlated with those it has."""
    p = np.diag(both) / max(1, n)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(dev, dev)
    left, parts = list(range(BITS)), []
    for k in range(m):
        part = [left.pop(0)]
        while len(part) < BITS * (k + 1) // m - BITS * k // m:
            part.append(left.pop(int(np.argmax(tied[np.ix_(left, part)].sum(1)))))
        parts.append(sorted(part))
    return parts


class Plan:
    """Partitions of the bits and the deal of thresholds."""

    def __init__(self, parts: list[list[int]], p: np.ndarray, n: int, tau: int = TAU) -> None:
        self.parts, self.p, self.n, self.tau, self.m = parts, p, n, tau, len(parts)
        self.total = tau - self.m + 1
        self.masks = [[self.flips(part, t) for t in range(tau + 1)] for part in parts]
        self.all_flips = np.concatenate([self.flips(range(BITS), t) for t in range(tau + 1)])

    @staticmethod
    def flips(bits, t: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for c in combinations(bits, t)], U).view(np.int64)

    def mask(self, k: int) -> int:
        return int(np.array([sum(1 << b for b in self.parts[k])], U).view(np.int64)[0])

    def estimates(self, fps: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """cost[class, partition, t + 1]: probes and candidates at threshold t. counts: classes with equal bits there
        (exact); those at one and two bits are estimated from the bits' frequencies."""
        x, cost = bits_of(fps), np.zeros((len(fps), self.m, self.tau + 2))
        for k, part in enumerate(self.parts):
            like = np.where(x[:, part] == 1, self.p[part], 1 - self.p[part]).clip(1e-6, 1 - 1e-6)
            odds, exact = (1 - like) / like, self.n * like.prod(1)
            ways = [np.ones(len(fps))]
            for t in range(1, self.tau + 1):  # elementary symmetric sums of the odds, by Newton's identities
                ways.append(sum((-1) ** (j - 1) * ways[t - j] * (odds**j).sum(1) for j in range(1, t + 1)) / t)
            for t in range(self.tau + 1):
                near = counts[:, k] + sum(exact * ways[j] for j in range(1, t + 1))
                cost[:, k, t + 1] = near + sum(comb(len(part), j) for j in range(t + 1))
        return cost

    def deal(self, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds of least total cost that sum to tau - m + 1, by dynamic programming over partitions; and that cost."""
        n, m, kinds = cost.shape
        width = m * kinds
        best = np.full((n, width), np.inf)
        best[:, 0] = 0
        took = np.zeros((m, n, width), np.int64)
        for k in range(m):
            now = np.full((n, width), np.inf)
            for j in range(kinds):
                moved = np.full((n, width), np.inf)
                moved[:, j:] = best[:, : width - j] + cost[:, k, j, None]
                better = moved < now
                now, took[k] = np.where(better, moved, now), np.where(better, j, took[k])
            best = now
        at = np.full(n, self.total + m)
        least, out = best[np.arange(n), at], np.zeros((n, m), np.int64)
        for k in reversed(range(m)):
            out[:, k] = took[k, np.arange(n), at] - 1
            at = at - out[:, k] - 1
        return out, least

    def probes(self, fps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Partition, key and fingerprint of every probe; partition -1 holds whole fingerprints."""
        thresholds, least = self.deal(self.estimates(fps, counts))
        whole = least > len(self.all_flips)
        out = [(-1, fps[whole], self.all_flips[1:])] if whole.any() else []
        for k, t in product(range(self.m), range(self.tau + 1)):
            rows = fps[~whole & (thresholds[:, k] >= t)]
            if len(rows):
                out.append((k, rows, self.masks[k][t]))
        part = [np.full(len(r) * len(f), k) for k, r, f in out]
        key = [((r[:, None] ^ f) & (self.mask(k) if k >= 0 else -1)).ravel() for k, r, f in out]
        fp = [np.repeat(r, len(f)) for _, r, f in out]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (part, key, fp))


def plan_for(classes: DataFrame, n: int, tau: int = TAU) -> Plan:
    """The number of partitions (2 to tau + 1) whose cheapest equal deal is least on average, and its partitions."""
    both = bit_statistics(classes)
    p = np.diag(both) / max(1, n)
    match = p * p + (1 - p) * (1 - p)
    best = None
    for m in range(2, tau + 2):
        parts = partition_bits(both, n, m)
        plan, cost = Plan(parts, p, n, tau), 0.0
        steps = sorted(np.sum([comb(len(x), j) for j in range(plan.total + 1)]) + n * match[x].prod() for x in parts)
        if plan.total == 0:
            cost = sum(1 + n * match[x].prod() for x in parts)
        else:  # one partition may differ in some bits, the others none or are left out
            odds = [((1 - match[x]) / match[x]).sum() for x in parts]
            cost = min(n * match[x].prod() * (1 + o) + steps[0] for x, o in zip(parts, odds, strict=True))
        if best is None or cost < best[0]:
            best = (cost, plan)
    return best[1]


def links(classes: DataFrame, plan: Plan, where: str) -> DataFrame:
    """Pairs (a, b) of classes' fingerprints at 1 to tau differing bits, each both ways."""
    masks = F.array(*(F.lit(plan.mask(k)) for k in range(plan.m)))
    keyed = classes.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("part", "key"))
    counts = keyed.groupBy("part", "key").agg(F.count("*").alias("n"))
    counted = keyed.join(counts, ["part", "key"]).groupBy("fp").agg(
        *(F.max(F.when(F.col("part") == k, F.col("n"))).alias(f"n{k}") for k in range(plan.m))
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        counts = np.stack([batch.column(f"n{k}").to_numpy(zero_copy_only=False) for k in range(plan.m)], 1)
        part, key, fp = plan.probes(fps, counts)
        return pa.RecordBatch.from_pydict({"part": pa.array(part.astype(np.int32)), "key": pa.array(key), "a": pa.array(fp)}) if len(fp) else None

    probes = in_arrow(counted.repartition(F.col("fp")), run, "part int, key long, a long")
    index = keyed.select("part", "key", F.col("fp").alias("b")).union(classes.select(F.lit(-1), F.col("fp"), F.col("fp")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, plan.tau)
    x, y = probes.alias("x"), index.alias("y")
    one = x.join(y, (F.col("x.part") == F.col("y.part")) & (F.col("x.key") == F.col("y.key")) & near).select("a", "b")
    return stash(one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{where}/links")


def components(pairs: DataFrame, where: str, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node reachable) of every node that has a link. pairs: a, b (longs), both ways.

    Alternates large-star (larger neighbours hang on the least one) and small-star (smaller neighbours
    and the node itself do) until no edge changes; each round starts from a written table. Rounds never add edges;
    where these are few, a round is one task."""
    edges = stash(pairs.where("a > b"), f"{where}/edges")
    few = n_rows(edges) <= BROADCAST_ROWS
    last = None
    for k in range(most_rounds):
        both = together(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), few)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.hint("merge") if few else least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down.hint("merge") if few else down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(down.select("a", F.col("m").alias("b")))
        with planned_once(pairs.sparkSession, few):
            edges = stash(together(small, few).distinct(), f"{where}/edges-{k}")
            state = tuple(together(edges, few).agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        last = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, tau: int = TAU, where: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, and the component's rows of every document. where: a folder for its tables, which
    the result reads."""
    where = where or shared_dir(docs.sparkSession)
    rows = stash(fingerprints(docs), f"{where}/rows")
    classes = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), f"{where}/classes")
    plan = plan_for(classes, n_rows(classes), tau)
    found = components(links(classes, plan, where), where)
    rooted = classes.join(found, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("component_rows"))
    named = stash(rooted.join(names, "root").select("fp", "component_id", "component_rows"), f"{where}/named")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_rows"
    )
