"""Token counts by heap-and-linked-list byte-pair merging.

A text's count is its initial symbols less the merges made. Two facts of the vocabulary keep
that cheap and exact: a merge only joins characters that stand side by side inside some piece,
so a text falls apart at every other boundary into parts that cannot influence each other; and
those parts repeat, so each worker keeps the counts of parts it has met (up to a fixed number;
parts beyond it are merged anew).

Defined cases: null and empty texts have 0 tokens; rows are counted one by one, so repeated rows
and doc_ids each give a row; null doc_ids pass through; extra columns are ignored; texts of any
length are counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.llm.shared import in_arrow, utf8

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Parts whose counts a worker keeps: about 150 bytes each.
KEPT_PARTS = 700_000
SPACE = "▁"


class PieceCounter(dict):
    """Counts by part of a text; missing parts are merged and, while there is room, kept."""

    def __init__(self, model_path: str, kept: int = KEPT_PARTS) -> None:
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.kept = kept
        self.rank: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        joined = {(p[i], p[i + 1]) for p in self.rank for i in range(len(p) - 1)}
        if any(b == SPACE != a for a, b in joined):
            raise ValueError("a piece goes on after a word's end; words cannot be counted apart")
        if "\n" in self.rank:
            raise ValueError("line feeds are expected to fall back to bytes")
        self.stops = "".join(c for c in ".,!|" if not any(b == c and a.isalpha() for a, b in joined))
        # the cut's class also has numerics that are no letters (superscripts, fractions); those that stand before a stop in a piece are left out
        joins = re.escape("".join(sorted({a for a, b in joined if b in self.stops and re.match(r"[^\W\d_]", a)})))
        self.before_stop = re.compile(rf"(?<=[^\W\d_{joins}])([{re.escape(self.stops)}])") if self.stops else None

    def __missing__(self, part: str) -> int:
        n = self.merged(part)
        if len(self) < self.kept:
            self[part] = n
        return n

    def merged(self, part: str) -> int:
        """Initial symbols less merges. The heap has (rank, place, characters) of adjacent pairs;
        links lead to the symbol before and after; a popped pair that no longer stands is skipped."""
        rank, n = self.rank, len(part)
        symbols = sum(1 if c in rank else len(utf8(c)) for c in part)
        if n < 2:
            return symbols
        heap = [(rank[pair], i, 2) for i in range(n - 1) if (pair := part[i : i + 2]) in rank]
        heapq.heapify(heap)
        size, before, after = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            _, left, length = heapq.heappop(heap)
            right = after[left]
            if not size[left] or right >= n or size[left] + size[right] != length:
                continue
            size[left], size[right] = length, 0
            after[left] = end = after[right]
            symbols -= 1
            if end < n:
                before[end] = left
                if (pair := part[left : end + size[end]]) in rank:
                    heapq.heappush(heap, (rank[pair], left, end + size[end] - left))
            if (start := before[left]) >= 0 and (pair := part[start : left + length]) in rank:
                heapq.heappush(heap, (rank[pair], start, left + length - start))
        return symbols

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if self.before_stop:
            text = self.before_stop.sub(r" \1", text)
        if SPACE + SPACE in text:  # runs of spaces merge among themselves and with the word that follows
            parts = re.findall(rf"{SPACE}+[^{SPACE} \n]*|[^{SPACE} \n]+|\n", text)
        else:
            parts = text.replace("\n", " \n ").replace(SPACE, " " + SPACE).split(" ")
        self[""] = 0
        return sum(map(self.__getitem__, parts))


_COUNTERS: dict[str, PieceCounter] = {}


def counter(model_path: str) -> PieceCounter:
    """One counter for each worker process and vocabulary."""
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = PieceCounter(model_path)
    return _COUNTERS[model_path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, count = batch.column("text").to_pylist(), counter(model_path).count
        tokens = [count(t) for t in texts]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_bytes": pa.array([len(utf8(t)) for t in texts], pa.int64()),
                "n_tokens": pa.array(tokens, pa.int64()),
                "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
            }
        )

    return in_arrow(docs.select("doc_id", "text"), run, SCHEMA)
