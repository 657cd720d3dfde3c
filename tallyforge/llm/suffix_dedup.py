"""Removal of bytes covered by 50-byte strings that an earlier document has: blockwise suffix sorting with a difference cover.

Sorting a suffix for every byte of a corpus would shuffle several times its size, so suffixes are
first divided into buckets by content, and only buckets that two documents share are sorted:

1. Every start of a 50-byte string belongs to an anchor, the first place of the least hash among the 24-byte
   strings inside it. Equal strings have equal anchors at equal offsets, so the anchor's hash names the
   suffix bucket. A run of starts with one anchor is a cell. Each batch of documents sends its distinct
   anchor hashes; hashes that one document alone has are done with.
2. The texts under the other cells (units) go to their buckets, equal ones of a batch once, for the
   least doc_id. A bucket's task takes one slice of buckets at a time: equal units collapse to their
   least doc_id; for the rest, ranks of a difference-cover sample (period 16) are computed once and
   suffixes are sorted by their first 16 bytes, the rank of the sample suffix that the cover gives them,
   their place from the anchor and their last 16 bytes, which together decide 50 bytes, so ties
   however long need no further reading. Neighbours that are equal in all are one string, owned by its least doc_id.
3. The starts that another document owns go back to their batch, which marks and counts bytes.

Starts of anchors of very many places are sent start by start under the hash of their own 50 bytes,
after equal ones of a batch were merged; so a passage that a third of all documents share is a row a batch, and its various surroundings
spread over tasks. Starts are worked on some hundred thousand at a time, of periodic text too. Every
decision compares bytes, never hashes alone.

A batch is some megabytes of text. The texts are shuffled once, into a table bucketed by batch in the
shared folder, from which the three passes read them in place; only what is sent between batches and
buckets is shuffled then.

Defined cases: a null text has no bytes; documents under 50 bytes lose nothing; a very long text is one
batch's, and takes some tens of bytes of memory a byte; repeats inside one document, and rows of one
doc_id, do not count against each other; rows of null doc_id are left whole and own nothing; repeated
rows each give a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import freed_shuffles, shared_dir, stash

U = np.uint64
LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1  # places an anchor can have in a string
PERIOD, COVER = 16, (0, 1, 2, 5, 8)  # every difference mod 16 is one of two members
STRIDE = 80  # bytes of a unit (at most SPAN + LENGTH - 1), padded
#: Bytes of text of a batch, on average; bytes hashed at once; places from which an anchor is sent start by start; starts sorted, and units merged, at once.
BATCH_BYTES, BLOCK, HOT, SLICE, STEP = 6 << 20, 1 << 15, 4096, 400_000, 1 << 18
PAD = (np.arange(STRIDE) < np.arange(LENGTH - 1, SPAN + LENGTH)[:, None]).astype(np.uint8)  # by count: which bytes are a unit's
AHEAD = np.array([min(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes at each place."""
    words = np.ndarray((len(x) - 7,), "<u8", x, strides=(1,)).astype(U)  # the 8 bytes at each place
    n = len(x) - GRAM + 1
    h = words[:n] * U(0x9E3779B97F4A7C15)
    shifted = h >> U(32)
    h ^= shifted
    for k, factor in ((8, 0xBF58476D1CE4E5B9), (16, 0x94D049BB133111EB)):
        h += words[k : k + n]
        h *= U(factor)
        np.right_shift(h, U(29), out=shifted)
        h ^= shifted
    return h


class Cells:
    """Cells of a batch of texts: first start, number of starts, place of the anchor from the first start, hash, and document.
    A start's anchor is the first place of the least hash among its SPAN places, so equal strings have it at equal offsets,
    in periodic text too. There, cells of one hash follow each other, each with as many starts as its anchor is far; they are held
    as one, of more starts than that. Blocks are so short that their arrays stay in a core's cache."""

    def __init__(self, texts: list[bytes], skip: np.ndarray) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        begin, n = self.ends - self.sizes, len(self.bytes) - LENGTH + 1
        room = np.maximum(self.sizes - LENGTH + 1, 0) * ~skip
        opens = begin[room > 0]
        cuts = np.searchsorted(opens, np.arange(0, max(n, 0) + BLOCK, BLOCK))
        parts = [self.block(lo, min(lo + BLOCK, n), opens[cuts[k] : cuts[k + 1]]) for k, lo in enumerate(range(0, n, BLOCK))]
        first, self.lead, self.hash = (np.concatenate([p[i] for p in parts] or [np.zeros(0, t)]) for i, t in enumerate((np.int64, np.uint8, U)))
        del parts
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.searchsorted(first, self.ends), prepend=0))
        count = np.minimum(np.append(first[1:], n)[: len(first)], (begin + room)[doc])
        count -= first
        inside = np.flatnonzero(count > 0)
        self.first, self.count, self.doc = first[inside], count[inside], doc[inside]
        self.lead, self.hash = self.lead[inside], self.hash[inside]

    def repeats(self) -> np.ndarray:
        """Number of anchors of each."""
        return -(-self.count // (self.lead.astype(np.int64) + 1))

    def block(self, lo: int, hi: int, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First starts of cells from lo to hi, as if the texts were one, and at `opens`; leads and hashes of their anchors."""
        before = min(lo, 1)  # the start before them, to see whether its anchor goes on
        h = gram_hashes(self.bytes[lo - before : hi + LENGTH - 1])
        value = h.view("<u4")[1::2].copy()
        least, n = value, 1
        while 2 * n <= SPAN:
            least, n = np.minimum(least[:-n], least[n:]), 2 * n
        least = np.minimum(least[: len(least) - (SPAN - n)], least[SPAN - n :])  # over SPAN places, one for each start
        fresh, less = np.ones(len(least), bool), np.zeros(len(least), bool)
        np.less(least[1:], least[:-1], out=less[1:])
        np.not_equal(least[1:], least[:-1], out=fresh[1:])
        fresh[1:] |= value[: len(least) - 1] == least[:-1]  # the anchor is passed
        fresh[opens - lo + before] = True
        fresh[:before] = False
        at = np.flatnonzero(fresh)
        lead = np.full(len(at), SPAN - 1, np.uint8)  # a new least hash stands at the last place
        search = np.flatnonzero(~less[at])
        lead[search] = (np.lib.stride_tricks.sliding_window_view(value, SPAN)[at[search]] == least[at[search], None]).argmax(1)
        own, opened = h[at + lead], np.zeros(len(least), bool)
        opened[opens - lo + before] = True
        goes_on = (own[1:] == own[:-1]) & (lead[1:] == lead[:-1]) & (np.diff(at) == lead[:-1] + 1) & ~opened[at[1:]]
        if goes_on.any():
            held = np.flatnonzero(np.append(True, ~goes_on))
            at, lead, own = at[held], lead[held], own[held]
        return at + (lo - before), lead, own


class Batch:
    """Documents of a group in a settled order, and their cells."""

    def __init__(self, table: pa.Table) -> None:
        ids, texts = table.column("doc_id").to_pylist(), [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.cells = Cells(self.texts, np.array([i is None for i in self.ids], bool))
        self.doc_ids = np.array([i or 0 for i in self.ids], np.int64)
        self.owner = self.doc_ids[self.cells.doc] if len(self.cells.doc) else np.zeros(0, np.int64)


def blobs(*arrays: np.ndarray) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def split_rows(part: np.ndarray, arrays: list[np.ndarray]) -> list[tuple[int, list[np.ndarray]]]:
    """Rows of the arrays by part."""
    order = np.argsort(part, kind="stable")
    keys, at = np.unique(part[order], return_index=True)
    cuts = [np.split(a[order], at[1:]) for a in arrays]
    return [(int(k), [c[i] for c in cuts]) for i, k in enumerate(keys)]


def as_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)


SENT = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
BACK = pa.schema([("batch", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
UNITS = pa.schema([("bucket", pa.int32()), ("batch", pa.int32())] + [(x, pa.binary()) for x in ("group", "owner", "unit", "lead", "size", "text")])
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("removed", SPANS)])
SHARED, STARTS = 0, 1  # kinds of what goes back to a batch


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", SPANS: "array<struct<start: long, end: long>>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def send_anchors(n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        batch, number = Batch(table.select(["doc_id", "text"])), table.column("batch")[0].as_py()
        order = np.argsort(batch.cells.hash)
        h, owner = batch.cells.hash[order], batch.owner[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        count, several = np.zeros(0, np.int64), np.zeros(0, "<u2")
        if len(h):
            count = np.add.reduceat(batch.cells.repeats()[order], first)
            several = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)).astype("<u2") << 15
        packed = several | np.minimum(count, 0x7FFF).astype("<u2")
        rows = split_rows((h[first] >> U(20)).astype(np.int64) % n_buckets, [h[first], packed])
        return as_table([(k, number, *blobs(*v)) for k, v in rows], SENT)

    return run


def shared_anchors(most: int):
    """Of a bucket's anchor hashes, those that two documents have, back to their batches; 1 marks those of over `most` places."""

    def run(table: pa.Table) -> pa.Table:
        h = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
        batch = np.repeat(table.column("batch").to_numpy(), [len(x) for x in h])
        h, counts = np.concatenate(h), np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u2")
        order = np.argsort(h, kind="stable")
        h, counts, batch = h[order], counts[order], batch[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.diff(np.append(first, len(h)))
        places = np.add.reduceat((counts & 0x7FFF).astype(np.int64), first)
        shared = np.repeat((n > 1) | np.logical_or.reduceat(counts >> 15 > 0, first), n)
        hot = np.repeat(places > most, n).astype(np.uint8)
        rows = split_rows(batch[shared], [h[shared], hot[shared]])
        return as_table([(k, SHARED, *blobs(*v)) for k, v in rows], BACK)

    return run


class Units:
    """Texts under a batch's shared cells: whole cells, and single starts. Equal ones have one representative, the first of
    the least doc_id; only representatives (start, count, owner, lead, group) are held, and the number of each unit's own."""

    def __init__(self, batch: Batch, back: pa.Table) -> None:
        kind = back.column("kind").to_numpy()
        take = lambda name, k: [x for x, y in zip(back.column(name).to_pylist(), kind, strict=True) if y == k]
        h, hot = np.frombuffer(b"".join(take("a", SHARED)), "<u8"), np.frombuffer(b"".join(take("b", SHARED)), np.uint8)
        order = np.argsort(h)
        h, hot, c = h[order], hot[order], batch.cells
        low = U((1 << (8 * len(h)).bit_length()) - 1)
        seen = np.zeros(int(low) + 1, bool)  # most cells of other hashes are told by the low bits
        seen[h & low] = True
        known = np.flatnonzero(seen[c.hash & low])
        at = np.minimum(np.searchsorted(h, c.hash[known]), max(0, len(h) - 1))
        same = h[at] == c.hash[known] if len(h) else np.zeros(0, bool)
        known, very = known[same], hot[at[same]] > 0
        self.batch, self.whole, self.single = batch, known[~very], known[very]
        self.bytes = np.append(c.bytes, np.zeros(STRIDE, np.uint8))
        held, self.number, n = [], [], 0
        for cell, start, count, single in self.steps():
            found, number = self.merge(cell, start, count, single)
            held.append(found)
            self.number.append(number + n)
            n += len(found[0])
        names = (np.int64, np.uint8, np.int64, np.uint8, U, U)
        self.start, self.count, self.owner, self.lead, self.group, own = (np.concatenate([x[i] for x in held] or [np.zeros(0, t)]) for i, t in enumerate(names))
        order = np.lexsort((self.start, self.key(self.group, own, self.count, self.lead)))  # later starts have no lesser owner
        self.chosen = np.empty(n, np.int64)
        self.chosen[order] = order[self.heads(order)] if n else order

    def steps(self):
        """Cell, start, number of starts, and whether they are single starts, of at most about STEP units at a time."""
        c, repeats = self.batch.cells, self.batch.cells.repeats()
        for rows, single in ((self.whole, False), (self.single, True)):
            n = c.count[rows] if single else repeats[rows]
            ends = np.cumsum(n)
            for lo in range(0, int(n.sum()), STEP):
                number = np.arange(lo, min(lo + STEP, int(ends[-1])))
                row = np.searchsorted(ends, number, "right")
                cell = rows[row]
                size = 1 if single else c.lead[cell].astype(np.int64) + 1
                done = (number - (ends - n)[row]) * size
                yield cell, c.first[cell] + done, np.minimum(c.count[cell] - done, size).astype(np.uint8), single

    def text(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The units' bytes, padded."""
        out = np.lib.stride_tricks.sliding_window_view(self.bytes, STRIDE)[start]
        out *= PAD[count]
        return out

    @staticmethod
    def key(group: np.ndarray, own: np.ndarray, count: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """One number of what equal units have in common."""
        key = group * U(0x9E3779B97F4A7C15) ^ own  # group is own for single starts
        key ^= (count.astype(U) << U(8)) | lead
        return key

    def merge(self, cell: np.ndarray, start: np.ndarray, count: np.ndarray, single: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """Representatives of some units, and for each unit the number of its own. Single starts are grouped by their own bytes."""
        c, text = self.batch.cells, self.text(start, count)
        own = (count + np.uint8(LENGTH - 1)).astype(U)
        for word in text.view("<u8").T:
            own = (own ^ word) * U(0x9E3779B97F4A7C15)
            own ^= own >> U(29)
        lead, group, owner = np.zeros(len(cell), np.uint8) if single else c.lead[cell], own if single else c.hash[cell], self.batch.owner[cell]
        key = self.key(group, own, count, lead)
        order = np.argsort(key, kind="stable")  # starts ascend, so the first of a run has the least doc_id
        new = np.ones(len(order), bool)
        maybe = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        a, b = order[maybe + 1], order[maybe]
        new[maybe + 1] = (group[a] != group[b]) | (count[a] != count[b]) | (lead[a] != lead[b]) | (text[a] != text[b]).any(1)
        number = np.empty(len(order), np.int32)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        return [start[first], count[first], owner[first], lead[first], group[first], own[first]], number

    def heads(self, order: np.ndarray) -> np.ndarray:
        """In that order, the place of the first of each run of equal representatives."""
        same = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        maybe = np.flatnonzero((self.group[a] == self.group[b]) & (self.count[a] == self.count[b]) & (self.lead[a] == self.lead[b]))
        for lo in range(0, len(maybe), STEP):
            k = maybe[lo : lo + STEP]
            same[k + 1] = (self.text(self.start[a[k]], self.count[a[k]]) == self.text(self.start[b[k]], self.count[b[k]])).all(1)
        return np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))


def send_units(n_buckets: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows or not back.num_rows:
            return as_table([], UNITS)
        u, number = Units(Batch(docs.select(["doc_id", "text"])), back), docs.column("batch")[0].as_py()
        pick = np.unique(u.chosen)
        bucket = (u.group[pick] >> U(20)).astype(np.int64) % n_buckets
        pick, rows = pick[np.argsort(bucket, kind="stable")], []
        for lo in range(0, len(pick), STEP):
            p = pick[lo : lo + STEP]
            arrays = [u.group[p], u.owner[p], p.astype("<i4"), u.lead[p], u.count[p], u.text(u.start[p], u.count[p])]
            parts = split_rows((u.group[p] >> U(20)).astype(np.int64) % n_buckets, arrays)
            rows += [(k, number, *blobs(*v[:5]), pa.compress(v[5].tobytes(), "zstd", asbytes=True)) for k, v in parts]
        return as_table(rows, UNITS)

    return run


def words_at(x: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The n bytes from each place as big-endian words, first word first."""
    cut = np.zeros((len(at), -(-n // 8) * 8), np.uint8)
    if len(at):
        cut[:, :n] = np.lib.stride_tricks.sliding_window_view(x, n)[at]
    return list(cut.view(">u8").astype(U).T)


def ranks(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order by keys, most significant first, and for each row the number of its class of equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return order, out


def owned_elsewhere(group: np.ndarray, owner: np.ndarray, lead: np.ndarray, count: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each distinct unit of a slice of buckets, the starts (bits) whose string a lesser doc_id has."""
    x = text.ravel()
    base = np.arange(len(group)) * STRIDE
    # ranks of the difference-cover sample: suffixes at cover residues from the anchor, to 34 bytes
    grid = np.arange(SPAN + PERIOD)
    sampled = np.isin((grid - lead[:, None]) % PERIOD, COVER) & (grid + LENGTH - PERIOD <= (count + LENGTH - 1)[:, None])
    unit, place = np.nonzero(sampled)
    cover_rank = np.full((len(group), len(grid)), -1, np.int64)
    cover_rank[unit, place] = ranks(words_at(x, base[unit] + place, LENGTH - PERIOD))[1]
    unit = np.repeat(np.arange(len(group)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    ahead = lead[unit] - place  # of the anchor; ranks of suffixes at other places from it do not compare, and equal strings have it alike
    tie = cover_rank[unit, place + AHEAD[-ahead % PERIOD]] << 5 | ahead
    at = base[unit] + place
    keys = [group[unit], *words_at(x, at, PERIOD), tie, *words_at(x, at + LENGTH - PERIOD, PERIOD)]
    _, which = ranks(keys)
    least = np.full(which.max() + 1 if len(which) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, which, owner[unit])
    lost = np.zeros(len(group), U)
    gone = least[which] < owner[unit]
    np.bitwise_or.at(lost, unit[gone], U(1) << place[gone].astype(U))
    return lost


def sort_buckets(table: pa.Table) -> pa.Table:
    """Starts that a lesser doc_id owns, of all units of a bucket, back to their batches."""
    read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    group, owner, unit, lead, count = read("group", "<u8"), read("owner", "<i8"), read("unit", "<i4"), read("lead", np.uint8), read("size", np.uint8)
    n_rows = [len(x) // 4 for x in table.column("unit").to_pylist()]
    batch = np.repeat(table.column("batch").to_numpy(), n_rows)
    raw = [pa.decompress(x, n * STRIDE, "zstd", asbytes=True) for x, n in zip(table.column("text").to_pylist(), n_rows, strict=True)]
    text = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, STRIDE)
    lead, count = lead.astype(np.int64), count.astype(np.int64)
    mixed = group.copy()
    for k in range(STRIDE // 8):
        mixed = (mixed ^ text.view("<u8")[:, k]) * U(0x9E3779B97F4A7C15)
        mixed ^= mixed >> U(29)
    order = np.lexsort((owner, mixed, group))
    group, owner, unit, lead, count, batch, text = (v[order] for v in (group, owner, unit, lead, count, batch, text))
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (lead[1:] != lead[:-1]) | (count[1:] != count[:-1]) | (text[1:] != text[:-1]).any(1)
    first, member = np.flatnonzero(new), np.cumsum(new) - 1  # equal units; the first has the least doc_id
    lost = np.zeros(len(first), U)
    g = group[first]
    opens = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    several = np.repeat(np.diff(np.append(opens, len(g))) > 1, np.diff(np.append(opens, len(g))))
    rest = np.flatnonzero(several)
    if len(rest):  # slices of whole buckets
        done = np.cumsum(count[first[rest]])
        edge = np.flatnonzero(np.append(True, g[rest][1:] != g[rest][:-1]))
        cuts, held = [0], 0
        for e in edge[1:].tolist():
            if done[e - 1] - held > SLICE:
                cuts.append(e)
                held = done[e - 1]
        for a, b in zip(cuts, [*cuts[1:], len(rest)], strict=True):
            rows = first[rest[a:b]]
            lost[rest[a:b]] = owned_elsewhere(group[rows], owner[rows], lead[rows], count[rows], text[rows])
    whole = (U(1) << count.astype(U)) - U(1)
    gone = np.where(owner > owner[first][member], whole, lost[member])
    keep = gone > 0
    rows = split_rows(batch[keep], [unit[keep].astype("<i4"), gone[keep].astype("<u8")])
    return as_table([(k, STARTS, *blobs(*v)) for k, v in rows], BACK)


def settle(docs: pa.Table, back: pa.Table) -> pa.Table:
    """Kept bytes and removed spans of every document of a batch, from the starts that came back and those settled inside the batch."""
    if not docs.num_rows:
        return as_table([], RESULT)
    batch = Batch(docs.select(["doc_id", "text"]))
    ends, sizes, raw = batch.cells.ends, batch.cells.sizes, batch.cells.bytes
    cut = np.zeros(len(raw), bool)  # starts of strings that go
    if back.num_rows:
        u = Units(batch, back)
        lost = np.zeros(len(u.start), U)
        for kind, a, b in zip(*(back.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True):
            if kind == STARTS:
                lost[np.frombuffer(a, "<i4")] = np.frombuffer(b, "<u8")
        for (cell, start, count, _), number in zip(u.steps(), u.number, strict=True):
            own = u.chosen[number]
            gone = np.where(batch.owner[cell] > u.owner[own], (U(1) << count.astype(U)) - U(1), lost[own])
            some = np.flatnonzero(gone)
            bits = np.flatnonzero(np.unpackbits(gone[some].astype("<u4").view(np.uint8), bitorder="little"))
            cut[start[some[bits >> 5]] + (bits & 31)] = True
    at, begin = np.flatnonzero(cut), ends - sizes
    new = np.append(True, np.diff(at) > LENGTH)[: len(at)]
    doc = np.searchsorted(at, begin)
    new[doc[doc < len(at)]] = True  # spans of two documents may touch
    first = at[new]
    last = at[np.append(new[1:], True)[: len(at)]] + LENGTH
    of = np.searchsorted(ends, first, "right")
    edges = np.zeros(len(raw) + 1, np.int8)
    edges[first] += 1
    edges[last] -= 1
    left = raw[np.cumsum(edges[:-1], dtype=np.int8) == 0]
    left_sizes = sizes.copy()
    np.subtract.at(left_sizes, of, last - first)
    offsets = np.append(0, np.cumsum(left_sizes)).astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(left)])
    spans = pa.StructArray.from_arrays([pa.array(first - begin[of]), pa.array(last - begin[of])], ["start", "end"])
    removed = pa.ListArray.from_arrays(pa.array(np.append(0, np.searchsorted(first, ends)).astype(np.int32)), spans)
    return pa.Table.from_arrays([pa.array(batch.ids, pa.int64()), pa.array(sizes), kept, removed], names=RESULT.names)


def in_batches(docs: DataFrame, where: str, batch_bytes: int) -> tuple[DataFrame, int]:
    """doc_id, text and batch in a table bucketed by batch, and the number of batches. Rows go to batches by a hash of
    their own, so neither one doc_id nor null ones fill a batch."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches = max(1, -(-n_bytes // batch_bytes))
    n_files = min(n_batches, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes >> 27))
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_batches)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long"), "text", number.alias("batch")).repartition(n_files, "batch")
    name = f"tallyforge_texts_{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        rows.write.options(path=f"{where}/texts", compression="zstd").bucketBy(n_files, "batch").saveAsTable(name, format="parquet")
    return spark.table(name), n_batches


def suffix_dedup(docs: DataFrame, batch_bytes: int = BATCH_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, kept (bytes) and removed (spans of bytes) of every document."""
    where = shared_dir(docs.sparkSession)
    rows, n_batches = in_batches(docs, where, batch_bytes)
    n_buckets = max(4, n_batches // 2)
    sent = rows.groupBy("batch").applyInArrow(send_anchors(n_buckets), ddl(SENT))
    shared = stash(sent.groupBy("bucket").applyInArrow(shared_anchors(hot), ddl(BACK)), f"{where}/shared")
    units = rows.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(send_units(n_buckets), ddl(UNITS))
    starts = stash(units.groupBy("bucket").applyInArrow(sort_buckets, ddl(BACK)), f"{where}/starts")
    return rows.groupBy("batch").cogroup(shared.union(starts).groupBy("batch")).applyInArrow(settle, ddl(RESULT))


def digests(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what suffix_dedup returns."""
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
