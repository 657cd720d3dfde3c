"""Secret scans: three known shapes, and strings that a tiktoken vocabulary cannot compress.

The known shapes are assignments to a secret's name, access key ids and long hexadecimal strings. The
method adds unbroken strings of at least LEAST characters that have at most RATIO characters a token:
words, paths and names of any language that the vocabulary has met take two characters or more a token,
random strings about one and a half. Known digests (hexadecimal of a digest's length, integrity values)
and identifiers (UUIDs, numbers, dates, strings of few different characters) are left out, as are
strings that meet a span of the known shapes, which tell of them already.

Defined cases: null and empty texts have no spans; very long texts and strings are read whole (a string
is encoded in blocks of BLOCK characters, so its cost is linear); spans are in code points; rows are
judged one by one, so repeated rows and doc_ids each give a row and null doc_ids pass through; an empty
table gives an empty result; extra columns are ignored unless keep names them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import in_arrow

#: Strings from LEAST characters on with at least DISTINCT different ones are judged; at most RATIO characters a token are random.
LEAST, DISTINCT, RATIO, BLOCK = 20, 8, 2.0, 2048
SPAN = "array<struct<kind: string, start: int, end: int, ratio: double>>"

# The known shapes, each with the group and the length that count, in the order of their kinds.
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SHAPES = (("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32))
KINDS = (*(k for k, _, _, _ in SHAPES), "random")
# Lengths of digests in hexadecimal (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), and of identifiers.
DIGEST = r"(?:sha\d+-)?(?:[0-9A-Fa-f]{128}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32})"
INTEGRITY = r"sha(?:256-[A-Za-z0-9+/]{43}=|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86}==)"
UUID = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
NUMBERS = r"[0-9+/_=TZ-]*"

_FOUND = [(kind, re.compile(pattern), group, least) for kind, pattern, group, least in SHAPES]
_KNOWN = re.compile("|".join(f"(?:{p})" for p in (DIGEST, INTEGRITY, UUID, NUMBERS)))
_ENCODINGS: dict[tuple[str, str], object] = {}


def encoding(ranks_path: str, pattern: str):
    """One encoding for each worker process, vocabulary and pattern."""
    import tiktoken

    if (ranks_path, pattern) not in _ENCODINGS:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODINGS[ranks_path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[ranks_path, pattern]


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """kind, start and end of the known shapes. A match whose counted part is too short is dropped, and what it took is not looked at again."""
    for kind, pattern, group, least in _FOUND:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield kind, m.start(), m.end()


def random_spans(text: str, taken: list[tuple[int, int]], coder, least: int = LEAST, ratio: float = RATIO) -> Iterator[tuple[str, int, int, float]]:
    """Strings outside the taken spans (in order of their starts) that have few characters a token."""
    at, end = 0, -1
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{least},}}", text):
        while at < len(taken) and taken[at][0] < m.end():
            end, at = max(end, taken[at][1]), at + 1
        whole = m[0].strip("=-_/+")
        if end > m.start() or len(whole) < least or len(set(whole)) < DISTINCT or _KNOWN.fullmatch(m[0]) or _KNOWN.fullmatch(whole):
            continue
        tokens = sum(len(coder.encode_ordinary(whole[a:b])) for a, b in pairwise([*range(0, len(whole), BLOCK), len(whole)]))
        if len(whole) <= ratio * tokens:
            start = m.start() + m[0].index(whole)
            yield "random", start, start + len(whole), len(whole) / tokens


def spans(text: str | None, coder, least: int = LEAST, ratio: float = RATIO) -> list[tuple[str, int, int, float | None]]:
    """All spans by start, then kind."""
    found = [(*s, None) for s in base_spans(text or "")]
    taken = sorted((start, end) for _, start, end, _ in found)
    return sorted([*found, *random_spans(text or "", taken, coder, least, ratio)], key=lambda s: (s[1], KINDS.index(s[0])))


def secret_scan(docs: DataFrame, ranks_path: str, pattern: str, least: int = LEAST, ratio: float = RATIO, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, spans (kind, start, end, and characters a token of random strings), and the columns of keep."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoding(ranks_path, pattern)
        each = [[dict(zip(("kind", "start", "end", "ratio"), s)) for s in spans(t, coder, least, ratio)] for t in batch.column("_text").to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("ratio", pa.float64())]))
        arrays = {c: batch.column(c) for c in batch.schema.names if c != "_text"}
        return pa.RecordBatch.from_pydict({"doc_id": arrays.pop("doc_id").cast(pa.int64()), "spans": pa.array(each, kind)} | arrays)

    rows = docs.select("doc_id", F.col("text").alias("_text"), *keep)
    kept = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return in_arrow(rows, run, f"doc_id long, spans {SPAN}{kept}")


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with each run of spans replaced by a mark."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mark))
        return F.struct(F.when((s["start"] < acc["at"]) & (acc["at"] > 0), acc["out"]).otherwise(fresh).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(found, empty, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the numbers of each kind, base_sha256 and the spans as text."""
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written = lambda array: F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *(number(k) for k in KINDS[:3]), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), number("random"))
