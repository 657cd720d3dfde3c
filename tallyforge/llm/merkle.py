"""Merkle manifest of a dataset: digests of rows, a tree for each source, one root, and proofs that are recomputed.

A row's leaf is the SHA-256 of its fields. The leaves of a source ascend by doc_id; every `fanout`
consecutive nodes become their parent until one is left, the source's subroot, and the subroots become
the root in the same way. Each level is a table: nodes have the number of their row within their group,
that number divided by the fanout names the parent, and the sorted digests of a parent's children are
hashed into it. The way down joins each level's children with their parent's path, so a node's siblings
stand once for its run and not once for every row below; a leaf's path is folded with what the leaf is
now, and compared with the root.

Numbers of rows come from sorted range partitions and the counts of the partitions before, so a source
with most of the rows is dealt over all tasks. Texts are read once; only digests are shuffled.

Defined cases: null fields are `-`, an empty text is `0:`; leaves without doc_id come first; rows of one
source and doc_id go by their leaf digests; equal rows are leaves each; a null source is a group of its
own, before all others; very long texts are hashed whole; an empty table gives an empty result and has
no root; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import ascii_lower, shared_dir, small, stash

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_PER_TASK = 1_000_000
PLACE = (1 << 33) - 1
NO_PATH = "array<struct<before: string, after: string>>"


def framed(field: Column) -> Column:
    """A field as it goes into a leaf: its UTF-8 length, a colon and its value; `-` for null."""
    value = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(framed(text if f == "text" else F.col(f)) for f in FIELDS)), 256)


def numbered(rows: DataFrame, where: str, order: list[Column]) -> DataFrame:
    """rows with idx, the place of each in its `grp` by the order, and n, the rows of the grp."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_TASK))
    keys = [F.col("grp").asc_nulls_first(), *order]
    ranged = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    at = stash(ranged.withColumn("at", F.monotonically_increasing_id()), f"{where}-ordered").withColumn("part", F.shiftright("at", 33))
    counts = stash(at.groupBy("grp", "part").agg(F.count("*").alias("c"), F.min("at").alias("least")), f"{where}-counts")
    of_group = Window.partitionBy("grp")  # a row for each task that holds rows of the group
    before = F.coalesce(F.sum("c").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stash(counts.select(F.col("grp").alias("g"), F.col("part").alias("p"), (before - F.col("least")).alias("shift"), F.sum("c").over(of_group).alias("n")), f"{where}-offsets")
    placed = at.join(small(offsets), (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return placed.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "g", "p", "shift")


class Forest:
    """The levels of the trees of all groups. nodes: grp, idx, n, digest and further columns that stay with the lowest level.

    runs[k]: grp, run, n and kids (idx, digest, and extra on the lowest level) of the nodes of level k that have a parent;
    tops[k]: grp, digest of those that have none."""

    def __init__(self, nodes: DataFrame, where: str, fanout: int = FANOUT) -> None:
        self.runs: list[DataFrame] = []
        self.tops: list[DataFrame] = []
        most = nodes.agg(F.max("n")).first()[0] or 0
        while True:
            level = len(self.tops)
            self.tops.append(nodes.where("n = 1").drop("n", "idx"))
            if most <= 1:
                return
            kid = F.struct("idx", *(c for c in nodes.columns if c not in ("grp", "n", "idx")))
            by_run = nodes.where("n > 1").groupBy("grp", F.floor(F.col("idx") / fanout).alias("run")).agg(F.array_sort(F.collect_list(kid)).alias("kids"), F.first("n").alias("n"))
            self.runs.append(stash(by_run, f"{where}-runs-{level}"))
            joined = F.sha2(F.array_join("kids.digest", ""), 256)
            nodes = self.runs[-1].select("grp", F.col("run").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), joined.alias("digest"))
            most = -(-most // fanout)

    def subroots(self) -> DataFrame:
        """grp and digest of every tree's last node."""
        return reduce(DataFrame.union, (t.select("grp", "digest") for t in self.tops))

    def paths(self, above: DataFrame) -> DataFrame:
        """The nodes of the lowest level with their columns, subroot, and path: the digests before and after the node in its
        run, those of its parent, and so on. above: grp, subroot, path of every tree's last node."""
        up = above.withColumnRenamed("grp", "g")
        same = F.col("grp").eqNullSafe(F.col("g"))
        over = self.tops[-1].join(up, same).drop("g").withColumn("idx", F.lit(0).cast("long"))
        for runs, tops in zip(reversed(self.runs), reversed(self.tops[:-1]), strict=True):
            parent = over.select(F.col("grp").alias("g"), F.col("idx").alias("i"), "subroot", "path")
            kids = runs.join(parent, same & (F.col("run") == F.col("i"))).select("grp", "subroot", "path", "kids", F.explode("kids").alias("kid"))
            side = lambda keep: F.array_join(F.transform(F.filter("kids", keep), lambda k: k["digest"]), "")
            own = F.struct(side(lambda k: k["idx"] < F.col("kid.idx")).alias("before"), side(lambda k: k["idx"] > F.col("kid.idx")).alias("after"))
            down = kids.select("grp", "kid.*", "subroot", F.concat(F.array(own), "path").alias("path"))
            over = down.unionByName(tops.join(up, same).drop("g").withColumn("idx", F.lit(0).cast("long")))
        return over


def hashed_rows(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """grp, doc_id, the row's digest, and that of its present state where it was tampered with."""
    now = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf(ascii_lower(F.col("text"))))
    return docs.select(F.col("source").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("digest"), now.alias("now"))


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row. tampered: rows whose present text has
    its A-Z in lower case; the tree is of the texts as they were."""
    spark, where = docs.sparkSession, shared_dir(docs.sparkSession)
    rows = stash(hashed_rows(docs, tampered).withColumn("scan", F.monotonically_increasing_id()), f"{where}/leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("scan")]  # scan deals equal rows over tasks
    trees = Forest(stash(numbered(rows, f"{where}/leaves", order).drop("scan"), f"{where}/nodes"), f"{where}/trees", fanout)
    # the subroots are the leaves of one more tree, ordered by their groups
    subroots = stash(trees.subroots(), f"{where}/subroots")
    one = numbered(subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("source"), "digest"), f"{where}/subroots", [F.col("source").asc_nulls_first()])
    crown = Forest(stash(one, f"{where}/crown"), f"{where}/crown", fanout)
    top = crown.subroots().first()
    root = F.lit(top.digest if top else None).cast("string")
    start = spark.range(1).select(F.lit(0).alias("grp"), F.lit("").alias("subroot"), F.array().cast(NO_PATH).alias("path"))
    above = stash(crown.paths(start).select(F.col("source").alias("grp"), F.col("digest").alias("subroot"), "path"), f"{where}/above")
    leaves = trees.paths(small(above))
    proof = F.array_join(F.flatten(F.transform("path", lambda s: F.array(s["before"], s["after"]))), "")
    folded = F.aggregate("path", F.coalesce("now", "digest"), lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))
    return leaves.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def fifth_of_ids() -> Column:
    """Rows whose decimal doc_id has an unsigned CRC-32 that 5 divides."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def oracle_sql() -> str:
    """manifest() of documents with fifth_of_ids(), for DuckDB."""
    field = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    one = lambda text: "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"
    octets = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    bits = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: {bits}), 4294967295)"
    climb = lambda start: f"""{start} UNION ALL SELECT k + 1, grp, idx // {FANOUT}, any_value((n + {FANOUT - 1}) // {FANOUT}), sha256(string_agg(digest, '' ORDER BY idx))
    FROM {{t}} WHERE n > 1 GROUP BY k, grp, idx // {FANOUT}"""  # noqa: E731
    path = lambda t: f"""SELECT a.grp, a.idx, b.k, string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx // ({FANOUT} ** b.k)::BIGINT) AS before,
    string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx // ({FANOUT} ** b.k)::BIGINT) AS after FROM (SELECT grp, idx FROM {t} WHERE k = 0) a
    JOIN {t} b ON a.grp IS NOT DISTINCT FROM b.grp AND b.n > 1 AND b.idx // {FANOUT} = a.idx // ({FANOUT} ** (b.k + 1))::BIGINT GROUP BY ALL"""  # noqa: E731
    return f"""WITH RECURSIVE leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
    FROM (SELECT doc_id, source, {one("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {one(lower)} END AS now FROM documents)),
t AS ({climb("SELECT 0 AS k, source AS grp, idx, n, leaf AS digest FROM leaves").format(t="t")}),
subs AS MATERIALIZED (SELECT grp AS source, digest AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
c AS ({climb("SELECT 0 AS k, 0 AS grp, idx, n, subroot AS digest FROM subs").format(t="c")}),
r AS (SELECT digest AS root FROM c WHERE n = 1),
low AS MATERIALIZED ({path("t")}), high AS MATERIALIZED ({path("c")}),
steps AS MATERIALIZED (SELECT l.source, l.idx, p.k AS step, coalesce(before, '') AS before, coalesce(after, '') AS after FROM leaves l JOIN low p ON l.source IS NOT DISTINCT FROM p.grp AND l.idx = p.idx
    UNION ALL SELECT l.source, l.idx, 1000 + p.k, coalesce(before, ''), coalesce(after, '') FROM leaves l JOIN subs s ON l.source IS NOT DISTINCT FROM s.source JOIN high p ON s.idx = p.idx),
paths AS MATERIALIZED (SELECT source, idx, list({{'b': before, 'a': after}} ORDER BY step) AS path, string_agg(before || after, '' ORDER BY step) AS proof FROM steps GROUP BY ALL),
f AS (SELECT doc_id, leaf, l.source, coalesce(proof, '') AS proof, coalesce(path, []) AS path, coalesce(now, leaf) AS digest, 1 AS i FROM leaves l LEFT JOIN paths p ON l.source IS NOT DISTINCT FROM p.source AND l.idx = p.idx
    UNION ALL SELECT doc_id, leaf, source, proof, path, sha256(path[i].b || digest || path[i].a), i + 1 FROM f WHERE i <= len(path))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified FROM f JOIN subs s ON f.source IS NOT DISTINCT FROM s.source, r WHERE i = len(path) + 1"""
