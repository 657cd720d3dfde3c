"""Product codes of vectors, with vantage-point trees over the entries of each part position.

Components become integers, vectors are cut into equal parts, and each part position has a codebook.
A round assigns every part to its nearest entry and replaces entries by the floored means of their
parts. The entries of a position stand in a vantage-point tree: a node has an entry and two halves of
the others by their distance from it, with the greatest and least distance of each half. A part visits
a half unless the triangle inequality puts it farther than the best entry so far. Bounds are rounded
so that they never exclude too much, a half that may tie is visited, and what decides is the integer
squared distance, then the lower index; so the trees change the cost and not the result.

Only codebooks and their sums (parts x entries x width numbers) come to the driver; each round is one
pass over a written table of integers, whose tasks give their own sums, and any of it can run again.

Defined cases: vectors that are null or hold null or non-finite components are left out, as are those
whose length is not the commonest one (the longest of those, if lengths tie); a length that the number
of parts does not divide, and components whose squared distances could pass 64 bits, raise an error;
the first entries are those of the rows with the least vec_ids (null last), equal vec_ids by their
components, each row counting; with fewer rows than entries the codebooks are as short; rows of one
vec_id each give a row; null labels are one label; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import in_arrow, shared_dir, small, stash

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LEAF, SALT = 2, 32
#: What float distances are widened by: over four times the rounding of a conversion, a root and a difference.
SLACK = 1e-15
CODES = "vec_id long, label {label}, code string, error long"


@dataclass(frozen=True)
class Node:
    """The entry at a node, and the halves of the others with the least and greatest distance from it, rounded apart."""

    entry: int
    halves: tuple[tuple[Tree, float, float], ...] = ()


Tree = Node | tuple[int, ...]  # a leaf is its entries


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.square(a - b).sum(-1)


def tree(entries: np.ndarray, members: tuple[int, ...] | None = None) -> Tree:
    """The tree over the rows of entries (integers)."""
    members = tuple(range(len(entries))) if members is None else members
    if len(members) <= LEAF:
        return members
    most = [squared(entries[list(members)], entries[i]).max() for i in members]
    at = members[int(np.argmax(most))]  # the vantage point sees the widest spread
    far = {i: float(np.sqrt(float(squared(entries[i], entries[at])))) for i in members if i != at}
    order = sorted(far, key=lambda i: (far[i], i))
    halves = (tuple(order[: len(order) // 2]), tuple(order[len(order) // 2 :]))
    return Node(at, tuple((tree(entries, h), far[h[0]] * (1 - SLACK), far[h[-1]] * (1 + SLACK)) for h in halves if h))


def nearest(x: np.ndarray, entries: np.ndarray, root: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of every row of x, the lower index at ties."""
    best, index = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries))

    def meet(entry: int, rows: np.ndarray) -> np.ndarray:
        d = squared(x[rows], entries[entry])
        better = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], entry
        return d

    def visit(node: Tree, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if not isinstance(node, Node):
            for entry in node:
                meet(entry, rows)
            return
        d = np.sqrt(meet(node.entry, rows).astype(np.float64))
        (near, _, edge), *other = node.halves
        inside = d <= edge  # these look into the nearer half first, the others last

        def enter(half: tuple[Tree, float, float], which: np.ndarray) -> None:
            part, least, most = half
            bound = np.maximum(least - d[which], d[which] - most) - SLACK * (d[which] + most)
            open_ = bound <= np.sqrt(best[rows[which]].astype(np.float64)) * (1 + SLACK)
            visit(part, rows[which][open_])

        enter(node.halves[0], inside)
        for half in other:
            enter(half, np.ones(len(rows), bool))
        enter(node.halves[0], ~inside)

    visit(root, np.arange(len(x)))
    return index, best


def assigned(x: np.ndarray, books: np.ndarray, trees: list[Tree]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By part position: index and squared distance of the nearest entry of every vector's part. x: vectors x parts x width."""
    for p, root in enumerate(trees):
        yield nearest(np.ascontiguousarray(x[:, p]), books[p], root)


def parts_of(batch: pa.RecordBatch, books: np.ndarray) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, books.shape[0], books.shape[2])


def integers(vectors: DataFrame, where: str, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, label and v (floors of the scaled components) of the vectors that are kept, in a table."""
    x = F.col("embedding")
    wild = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    floors = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    kept = vectors.where(x.isNotNull()).where(~F.coalesce(wild, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", floors.alias("v"))
    rows = stash(kept, f"{where}/integers")
    common = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = common.size if common else parts
    if not size or size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    most = isqrt(2**62 // size) // 2
    told = rows.where(F.size("v") == size)
    if told.where(F.exists("v", lambda c: F.abs(c) > most)).limit(1).count():
        raise ValueError(f"a component is beyond {most / scale:.0f}: squared distances would pass 64 bits")
    return told


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width integers) of the rows of integers()."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, len(first[0].v) // parts if first else 1).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        books = means(rows, books)
    return books


def means(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floored means of the parts assigned to each entry; unused entries stay."""
    n_parts, n_entries, width = books.shape
    trees = [tree(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_parts, n_entries, width + 1), np.int64)  # the last column counts
        for batch in batches:
            if batch.num_rows:
                x = parts_of(batch, books)
                for p, (index, _) in enumerate(assigned(x, books, trees)):
                    np.add.at(sums[p, :, :width], index, x[:, p])
                    sums[p, :, width] += np.bincount(index, minlength=n_entries)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(sums.size)), "total": pa.array(sums.ravel())})

    total = np.zeros(n_parts * n_entries * (width + 1), np.int64)
    for cell, value in rows.select("v").mapInArrow(run, "cell long, total long").groupBy("cell").agg(F.sum("total")).collect():
        total[cell] = value
    total = total.reshape(n_parts, n_entries, width + 1)
    count = total[..., width:]
    return np.where(count > 0, total[..., :width] // np.maximum(count, 1), books)


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part) and error of the rows of integers()."""
    trees, digits = [tree(b) for b in books], np.array([f"{i:02x}" for i in range(max(1, books.shape[1]))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [*assigned(parts_of(batch, books), books, trees)]
        code = ["".join(row) for row in np.stack([digits[index] for index, _ in found], 1)]
        return pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": pa.array(code), "error": pa.array(sum(best for _, best in found))})

    return in_arrow(rows, run, CODES.format(label=rows.schema["label"].dataType.simpleString()))


def decode(code: str, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for: the middles of its entries' steps."""
    return (np.concatenate([books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(books))]) + 0.5) / scale


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (the errors of all vectors of the label) and codebooks_sha256 of every vector kept."""
    where = shared_dir(vectors.sparkSession)
    rows = integers(vectors, where, parts=parts)
    books = fit(rows, parts, entries, rounds)
    if not books.size:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(books_digest(books)).alias("codebooks_sha256"))
    coded = stash(encode(rows, books), f"{where}/codes").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)))
    sums = coded.groupBy("label", "_salt").agg(F.sum("error").alias("s")).groupBy(F.col("label").alias("_label")).agg(F.sum("s").alias("label_error"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("_at")  # a label with most of the rows is dealt over these
    totals = small(stash(sums, f"{where}/labels").select("_label", "label_error", salts))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_at")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """vector_codes() of embeddings by comparing all entries, for DuckDB."""
    width = f"(len(v) // {PARTS})"
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    assign = lambda k: f"a{k} AS MATERIALIZED (SELECT rid, p.part, any_value(x) AS x, min({{'d': {distance}, 'e': entry}}) AS best FROM p JOIN c{k} c ON p.part = c.part GROUP BY rid, p.part)"
    floored = "(s - ((s % n) + n) % n) // n"
    steps = []
    for k in range(ROUNDS):
        steps.append(assign(k))
        steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m, c) AS c FROM c{k} c LEFT JOIN (SELECT part, entry, list({floored} ORDER BY pos) AS m FROM
    (SELECT part, best.e AS entry, pos, sum(x[pos])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, 1 + (SELECT max(len(x)) FROM p)) r(pos) GROUP BY ALL) GROUP BY ALL) n
    ON n.part = c.part AND n.entry = c.entry)""")
    return f"""WITH k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rid FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
p AS MATERIALIZED (SELECT rid, part, v[part * {width} + 1 : (part + 1) * {width}] AS x FROM k, range({PARTS}) r(part)),
c0 AS MATERIALIZED (SELECT part, rid AS entry, x AS c FROM p WHERE rid < {ENTRIES}),
{", ".join(steps)}, {assign(ROUNDS)},
e AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN e USING (rid), h"""
