"""Quality rules: a decision list learned by sequential covering from labelled statistics.

Statistics of every whole text are taken in one pass and written as a small table. The rules are
grown and pruned on a bounded sample of its labelled rows, those whose hashes lie below a threshold
that follows from their number, and are applied to all rows as one ordered Spark conditional expression.

Defined cases: a null text has no words (all statistics 0, base_failed); very long texts are judged whole;
repeated rows and doc_ids each give a row, and equal ones are learned from once; a doc_id whose labels
contradict each other, or are null, is not learned from; ties of gain go to the first feature and threshold;
with no labels (or one class only) the list is empty and every document that passes the base
checks is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import in_arrow, shared_dir, stash, utf8

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct")
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{x} long" for x in STATS)
BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER = bytes(range(65, 91))
#: Labelled rows that rules are learned from (expected number; by binomial spread at most a few per cent more).
SAMPLE_ROWS = 100_000
#: Ratios that conditions test, each from the statistics by the same expression in Spark and numpy.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
}


def repeated(words: np.ndarray) -> int:
    """Words inside windows of five that stand twice or more in the text. words: an id for each word."""
    n = len(words) - 4
    if n < 2:
        return 0
    mix = np.zeros(n, np.uint64)
    for k in range(5):
        mix = (mix + words[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    order = np.argsort(mix, kind="stable")
    same = mix[order][1:] == mix[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)  # equal windows have equal mixes; whether they are equal is settled on the words
    _, which, count = np.unique(words[at[:, None] + np.arange(5)], axis=0, return_inverse=True, return_counts=True)
    edges = np.zeros(len(words) + 1, np.int64)
    at = at[count[which.ravel()] > 1]
    np.add.at(edges, at, 1)
    np.add.at(edges, at + 5, -1)
    return int((np.cumsum(edges) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The STATS of one whole text. Bytes split at ASCII white space give the contract's words."""
    raw = utf8(text)
    words = raw.split()
    if not words:
        return (0,) * 5 + (raw.count(b"\n") + bool(raw), 0, 0)
    ids: dict[bytes, int] = {}
    coded = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        lines += 1
        if line in seen:
            dup += bool(line.strip())
        else:
            seen.add(line)
    drop = lambda what: len(raw) - len(raw.translate(None, what))
    return (len(words), len(text) - drop(BLANKS), drop(SYMBOLS), dup, repeated(coded), lines, drop(UPPER), len(ids))


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_stats(t) for t in batch.column("text").to_pylist()], np.int64)
        return pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id").cast(pa.int64())} | {x: pa.array(rows[:, i]) for i, x in enumerate(STATS)}
        )

    return in_arrow(docs.select("doc_id", "text"), run, STATS_SCHEMA)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.feature]
        return x >= self.threshold if self.at_least else x < self.threshold

    def column(self) -> Column:
        x = feature_column(self.feature)
        return x >= F.lit(self.threshold) if self.at_least else x < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def feature_column(name: str) -> Column:
    top, base = FEATURES[name]
    return F.col(top).cast("double") if base is None else F.col(top) / F.greatest(F.col(base), F.lit(1))


def features(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: stats[a].astype(float) if b is None else stats[a] / np.maximum(stats[b], 1) for k, (a, b) in FEATURES.items()}


def covers(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(values) for c in rule))


def grow(values: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> Rule:
    """Adds the condition of largest gain in information, until only bad rows are covered or nothing gains."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (p0 := int((bad & inside).sum())) < (all0 := int(inside.sum())) and p0:
        best, gain = None, 1e-9
        for name, at in cuts.items():
            x = values[name][inside]
            place = np.searchsorted(at, x, side="right")
            total = np.bincount(place, minlength=len(at) + 1)
            hit = np.bincount(place, bad[inside], minlength=len(at) + 1)
            for side in (True, False):
                p, n = ((np.cumsum(c[::-1])[::-1][1:] if side else np.cumsum(c)[:-1]) for c in (hit, total))
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / n) - np.log2(p0 / all0)), 0)
                if len(g) and g[k := int(np.argmax(g))] > gain:
                    best, gain = Condition(name, side, float(at[k])), float(g[k])
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(values)
    return rule


def worth(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> float:
    inside = covers(rule, values)
    return (2 * (bad & inside).sum() - inside.sum() + 0.5) / (inside.sum() + 1)


def prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Cuts last conditions while that is worth at least as much on the rows held apart."""
    while len(rule) > 1 and worth(rule[:-1], values, bad) >= worth(rule, values, bad):
        rule = rule[:-1]
    return rule


def learn(stats: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most_rules: int = 12, most_conditions: int = 4) -> list[Rule]:
    """Rules of rejection, in the order in which they were found. Every third row is held apart for
    pruning; a rule stands if it covers rows there at the asked precision, and learning stops at the first that does not."""
    rules: list[Rule] = []
    values = features(stats)
    apart = np.arange(len(bad)) % 3 == 2
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, 65)[1:])) for k, v in values.items()} if len(bad) else {}
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and (bad & left & ~apart).any():
        pick = lambda rows: {k: v[rows] for k, v in values.items()}
        rule = grow(pick(left & ~apart), bad[left & ~apart], cuts, most_conditions)
        if not rule:
            break
        rule = prune(rule, pick(left & apart), bad[left & apart])
        inside = covers(rule, values) & left
        held = inside & apart
        if not inside.any() or (bad & inside).sum() < precision * inside.sum() or (bad & held).sum() < precision * held.sum():
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the first rule that fires rejects; none keeps."""
    out = None
    for rule in rules:
        fires = reduce(lambda a, b: a & b, (c.column() for c in rule))
        out = F.when(fires, F.lit(False)) if out is None else out.when(fires, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learns from about sample_rows labelled rows: those whose hashes lie in the lowest share of that size.

    The share is applied on the executors, so that the driver receives the sample and no more."""
    agreed = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2"))
    )
    rows = stats.join(agreed.where("q = q2"), "doc_id").select(*STATS, "q", "doc_id").distinct()
    place = F.shiftrightunsigned(F.xxhash64("doc_id", *STATS), 11) / F.lit(float(2**53))
    share = min(1.0, sample_rows / max(1, rows.count()))
    sample = rows.where(place < share).toPandas().sort_values(["doc_id", *STATS], ignore_index=True)
    sample = sample.sample(frac=1, random_state=0)  # the rows held apart for pruning are then no pattern of doc_ids
    return learn({x: sample[x].to_numpy() for x in STATS}, (sample["q"] == 0).to_numpy())


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of every document."""
    stats = stash(document_stats(docs), f"{shared_dir(docs.sparkSession)}/stats")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.select(
        "doc_id", *STATS[:5], base_failed.alias("base_failed"), (~base_failed & verdict(fit(stats, labels, sample_rows))).alias("kept")
    )
