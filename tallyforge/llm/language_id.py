"""Language identification with a byte convolutional network trained in numpy.

Texts are cut whole into fixed-length windows of bytes that overlap by the widest filter less one.
Each window passes byte embeddings, filters of several widths, rectification, max pooling over places
and a softmax layer; a document's probabilities come from the mean of its windows' log probabilities.
In prediction a filter's response is looked up by byte pairs, which equals the convolution.

Training takes a bounded, hash-ordered sample per language (rows_per_language, and at most
WINDOWS_PER_TEXT windows of each text); the windows are cut on the executors.

Defined cases: null texts and texts without a letter give `und` with score 0; ties go to the
language that sorts first; repeated rows each give a row; rows without a language are not learned
from; if there is nothing to learn from, every document is `und` with score 0; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import in_arrow, utf8

#: Bytes of a window; filter widths; filters of each width; size of a byte's embedding.
LENGTH, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 8, 8
ROWS_PER_LANGUAGE, WINDOWS_PER_TEXT = 1500, 2
#: Batches that training takes.
STEPS = 1500
LETTER = re.compile(r"[^\W\d_]")
UND = "und"


def held_out(doc_id="doc_id"):
    """Documents whose crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text, the last one padded with spaces: (n, LENGTH) uint8."""
    step = LENGTH - max(WIDTHS) + 1
    n = max(1, -(-(len(raw) - LENGTH) // step) + 1)
    padded = np.frombuffer(raw.ljust((n - 1) * step + LENGTH), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[::step]


@dataclass
class Net:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # (width * DIM, FILTERS)
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def new(cls, languages: list[str], rng: np.random.Generator) -> Net:
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        return cls(
            languages, rng.normal(0, 0.5, (256, DIM)).astype(np.float32), [draw(w * DIM, FILTERS) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(len(WIDTHS) * FILTERS, len(languages)), np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.dense, self.dense_bias]

    def step(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy of windows x (n, LENGTH) with languages y."""
        n, emb = len(x), self.embedding[x]
        pooled, taken = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            cols = np.concatenate([emb[:, i : LENGTH - w + 1 + i] for i in range(w)], 2)
            act = cols @ f + b
            at = act.argmax(1)
            top = np.take_along_axis(act, at[:, None], 1)[:, 0]
            taken.append((at, cols[np.arange(n)[:, None], at]))
            pooled.append(top)
        pre = np.concatenate(pooled, 1)
        hidden = np.maximum(pre, 0)
        logits = hidden @ self.dense + self.dense_bias
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(n), y] -= 1
        d = prob / n
        dh = (d @ self.dense.T) * (pre > 0)
        g_emb = np.zeros_like(self.embedding)
        g_filters, g_bias = [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            at, cols = taken[k]
            dk = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g_filters.append(np.einsum("nfc,nf->cf", cols, dk))
            g_bias.append(dk.sum(0))
            back = (dk[:, :, None] * f.T[None]).reshape(n, FILTERS, w, DIM)
            for i in range(w):
                np.add.at(g_emb, x[np.arange(n)[:, None], at + i].ravel(), back[:, :, i].reshape(-1, DIM))
        return [g_emb, *g_filters, *g_bias, hidden.T @ d, d.sum(0)]

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width, responses by the first two bytes, and by the one or two bytes that follow them."""
        out = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            by = [self.embedding @ f[i * DIM : (i + 1) * DIM] for i in range(w)]
            pair = lambda i: (by[i][:, None] + by[i + 1][None]).reshape(-1, FILTERS)  # noqa: B023, E731
            out.append((pair(0) + b, None if w == 2 else by[2] if w == 3 else pair(2)))
        return out

    def log_probabilities(self, x: np.ndarray, tables, chunk: int = 256) -> np.ndarray:
        out = []
        for start in range(0, len(x), chunk):
            block = x[start : start + chunk]
            pairs = block[:, :-1].astype(np.intp) * 256 + block[:, 1:]
            pooled = []
            for w, (first, rest) in zip(WIDTHS, tables, strict=True):
                act = first.take(pairs[:, : LENGTH - w + 1], axis=0)
                if rest is not None:
                    act += rest.take(block[:, 2:] if w == 3 else pairs[:, 2:], axis=0)
                pooled.append(act.max(1))
            logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.dense + self.dense_bias
            logits -= logits.max(1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(1, keepdims=True)))
        return np.concatenate(out)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = STEPS, size: int = 64, rate: float = 0.005) -> Net:
    """Adam over shuffled batches from a fixed seed; as many steps whatever the sample's size."""
    rng = np.random.default_rng(7)
    net = Net.new(languages, rng)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    t = 0
    while t < steps:
        order = rng.permutation(len(x))
        for start in range(0, len(x), size):
            rows, t = order[start : start + size], t + 1
            for p, g, (m, v) in zip(net.parameters(), net.step(x[rows], y[rows]), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def training_windows(docs: DataFrame, rows_per_language: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of a bounded sample: of each language the rows whose hashes of doc_id are least."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(3.0 * rows_per_language) / F.col("n"))
    place = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), 11) / F.lit(float(2**53))).alias("place")
    near = rows.select("lang", "text", place).join(F.broadcast(counts.withColumn("share", share)), "lang").where(F.col("place") < F.col("share"))
    first = near.where(F.col("text").isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text")))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if LETTER.search(text):
                w = windows(utf8(text.lower()))
                rng = np.random.default_rng(len(text))
                for k in rng.permutation(len(w))[:WINDOWS_PER_TEXT]:
                    out.append((lang, w[k].tobytes()))
                short = w[0][: int(rng.integers(8, 80))].tobytes()
                if LETTER.search(short.decode("utf-8", "ignore")):
                    out.append((lang, short.ljust(LENGTH)))
        return pa.RecordBatch.from_pydict({"lang": pa.array([a for a, _ in out], pa.string()), "window": pa.array([b for _, b in out], pa.binary())})

    got = in_arrow(first.where(F.col("rank") <= rows_per_language).select("text", "lang"), cut, "lang string, window binary").toPandas()
    got = got.sort_values(["lang", "window"])
    languages = sorted(got["lang"].unique().tolist())
    x = np.frombuffer(b"".join(map(bytes, got["window"])), np.uint8).reshape(-1, LENGTH)
    return x, np.searchsorted(np.array(languages, object), got["lang"].to_numpy(object)) if languages else np.zeros(0, int), languages


_TABLES: dict[str, list] = {}


def predict(docs: DataFrame, net: Net | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, lang_pred and score of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        pred, score = [UND] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if net is not None and t is not None and LETTER.search(t)]
        if known:
            if net.name not in _TABLES:
                _TABLES.clear()
                _TABLES[net.name] = net.tables()
            start = 0
            while start < len(known):  # windows of about 4 MB of text at once
                stop, held = start, 0
                parts = []
                while stop < len(known) and (not parts or held < 4 << 20):
                    parts.append(windows(utf8(texts[known[stop]].lower())))
                    held += parts[-1].size
                    stop += 1
                logs = net.log_probabilities(np.concatenate(parts), _TABLES[net.name])
                edges = np.cumsum([0] + [len(p) for p in parts])[:-1]
                mean = np.add.reduceat(logs, edges) / np.array([len(p) for p in parts])[:, None]
                prob = np.exp(mean - mean.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                for i, p in zip(known[start:stop], prob, strict=True):
                    pred[i], score[i] = net.languages[int(p.argmax())], float(p.max())
                start = stop
        columns = [batch.column(c) for c in keep] + [pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double"
    return in_arrow(docs.select(*dict.fromkeys((*keep, "text"))), run, schema)


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Net | None:
    """Trains on text and lang of documents that are not held out; None if there are none."""
    x, y, languages = training_windows(docs, rows_per_language)
    return train(x, y, languages) if languages else None


def language_id(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    return predict(docs, fit(docs, rows_per_language)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
