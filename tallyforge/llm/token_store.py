"""Token ids as binary shards with keyed access.

Documents are sorted by doc_id over Spark partitions; each task encodes its texts and writes shards
of raw little-endian ids (two bytes each where the vocabulary allows it, else four) into the shared
folder, with an index file beside each: a minimal perfect hash from doc_id to the documents' places,
fingerprints, and offsets. Files are written under an attempt's name and renamed, so retried tasks
leave whole files; the manifest, a Parquet table, lists the shards that count.

Words repeat, and white space always ends a pre-token of the vocabularies used here, so each worker
asks the tokenizers library for a word's ids once and keeps them (up to a fixed number).

Keyed access asks the shards' least and greatest doc_ids for the shards that may hold a key, the index of
each for the record, and reads that record's bytes alone.

Defined cases: a null text is as an empty one and has the end id alone; a very long text is one record,
and alone fills a shard if need be; rows of one doc_id stay side by side, by the beginnings of their texts,
and may fill several partitions and shards; a key then finds all of them; null doc_ids come first in the
files and are not in the index; extra columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.perfect_hash import PerfectHash
from tallyforge.llm.shared import shared_dir, stash, utf8

MAGIC = b"TFTOK001"
#: Bytes of ids and documents in a shard, and bytes of text in a Spark partition.
SHARD_BYTES, SHARD_DOCS, PARTITION_BYTES = 32 << 20, 1 << 20, 64 << 20
#: Shards whose bounds are broadcast to look keys up (32 bytes each); of more, the keys in their indexes are joined instead.
BROADCAST_SHARDS = 1_000_000
#: Characters of text that are split into words at once.
PIECE = 2 << 20
#: Words whose ids a worker keeps: about 150 bytes each.
KEPT_WORDS = 600_000
MANIFEST = "part long, shard long, path string, n_docs long, n_ids long, min_id long, max_id long"
BACK = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Encoder:
    """Packed ids of texts, as tokenizers gives them for the whole text without special tokens added."""

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        self.special = [x["content"].lower().encode() for x in spec["added_tokens"]]
        self.by_word = self.words_stand_alone(spec)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.kept, self.known = kept, {}

    @staticmethod
    def words_stand_alone(spec: dict) -> bool:
        """True where texts are lower-cased and the pre-tokenizer drops what is not matched by a pattern without white space."""
        norm = json.dumps(spec.get("normalizer") or {})
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        return '"Lowercase"' in norm and first.get("behavior") == "Removed" and bool(first.get("invert"))

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype == '<u2' else 'I'}", *ids)

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words: of plain ASCII letters, one pre-token, by the library's model; of others by one call over all of them, told apart by their offsets."""
        known = self.known
        stems = {w[:-1] if w[-1:] in b".," and w[:-1].isalpha() else w for w in words} | {b".", b","}
        stems = {w for w in stems if w not in known}  # looks up the few new words, not the many known ones
        model, plain = self.tokenizer.model.tokenize, [w for w in stems if w.isalpha()]
        new = {w: self.pack([t.id for t in model(w.decode())]) for w in plain}
        need = sorted(stems - new.keys())
        texts = [w.decode("utf-8", "surrogatepass") for w in need]
        got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(got.ids, self.dtype)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        edges = np.searchsorted(np.array([a for a, _ in got.offsets], np.int64), starts) * ids.itemsize
        raw = ids.tobytes()
        new |= {w: raw[a:b] for w, a, b in zip(need, edges[:-1].tolist(), edges[1:].tolist(), strict=True)}
        stem = lambda w: new[w] if w in new else known[w]
        new |= {w: stem(w[:-1]) + stem(w[-1:]) for w in words if w not in new}
        return new

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Packed ids of each text in turn, worked on in pieces of PIECE characters or one text."""
        piece: list[str | None] = []
        held = 0
        for text in texts:
            piece.append(text)
            held += len(text or "")
            if held >= PIECE:
                yield from self.encode_piece(piece)
                piece, held = [], 0
        yield from self.encode_piece(piece)

    def encode_piece(self, texts: list[str | None]) -> list[bytes]:
        """Each word is looked up once; texts with new words are finished when those have been learnt together."""
        known, out, missing = self.known, [], set()
        open_texts: list[tuple[int, list[bytes], list[bytes | None]]] = []
        for text in texts:
            raw = utf8(text).lower()
            if self.by_word and not any(s in raw for s in self.special):
                words = raw.split()
                packed = list(map(known.get, words))
                if None in packed:
                    missing.update(w for w, ids in zip(words, packed, strict=True) if ids is None)
                    open_texts.append((len(out), words, packed))
                    out.append(b"")
                else:
                    out.append(b"".join(packed))
            else:
                out.append(self.pack(self.tokenizer.encode(text or "", add_special_tokens=False).ids))
        if missing:
            new = self.learn(missing)
            for place, words, packed in open_texts:
                out[place] = b"".join([new[w] if ids is None else ids for w, ids in zip(words, packed, strict=True)])
            if len(known) < self.kept:
                known.update(islice(new.items(), self.kept - len(known)))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def index_bytes(keys: np.ndarray, nulls: int, edges: np.ndarray, dtype: str) -> bytes:
    """keys: ascending doc_ids after the first `nulls` documents without one; edges: places of ids, one more than documents."""
    distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
    table = PerfectHash.build(distinct)
    by_slot = np.zeros((len(distinct), 2), "<u4")
    by_slot[table.slot(distinct)] = np.stack([first + nulls, count], 1)
    arrays = [keys.astype("<i8"), edges.astype("<u8"), table.sizes.astype("<i8"), table.words, table.fingerprints, by_slot.ravel()]
    head = json.dumps({"nulls": nulls, "dtype": dtype, "sizes": [len(a) for a in arrays], "types": [a.dtype.str for a in arrays]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(a.tobytes() for a in arrays)


class Shard:
    """A shard read back: keys in file order, and keyed access in constant time. read gives n bytes of the payload from a place."""

    def __init__(self, index: bytes, read: Callable[[int, int], bytes]) -> None:
        if index[:8] != MAGIC:
            raise ValueError("not an index of token shards")
        (size,) = struct.unpack("<I", index[8:12])
        head, at, arrays = json.loads(index[12 : 12 + size]), 12 + size, []
        for n, kind in zip(head["sizes"], head["types"], strict=True):
            arrays.append(np.frombuffer(index, kind, n, at))
            at += arrays[-1].nbytes
        self.nulls, self.dtype, self.read = head["nulls"], np.dtype(head["dtype"]), read
        self.keys, self.edges, sizes, words, fingerprints, by_slot = arrays
        self.hash, self.by_slot = PerfectHash(sizes, words, fingerprints), by_slot.reshape(-1, 2)

    @classmethod
    def whole(cls, path: str) -> Shard:
        payload = memoryview(read_bytes(f"{path}.bin"))
        return cls(read_bytes(f"{path}.idx"), lambda at, n: payload[at : at + n])

    def records(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; -1 and 0 for absent keys."""
        slots = self.hash.find(keys)
        known = slots >= 0
        first, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[known], count[known] = self.by_slot[slots[known]].astype(np.int64).T
        return first, count

    def record_ids(self, record: int) -> np.ndarray:
        a, b = int(self.edges[record]), int(self.edges[record + 1])
        return np.frombuffer(self.read(a * self.dtype.itemsize, (b - a) * self.dtype.itemsize), self.dtype)


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def read_bytes(path: str) -> bytes:
    system, name = file_system(path)
    with system.open_input_file(name) as f:
        return f.read()


def write_bytes(path: str, data: bytes) -> None:
    system, name = file_system(path)
    context = TaskContext.get()
    draft = f"{name}.{context.taskAttemptId() if context else 0}.tmp"
    with system.open_output_stream(draft) as f:
        f.write(data)
    system.move(draft, name)


def write_tokens(docs: DataFrame, tokenizer_path: str, where: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards and the manifest; returns the manifest with `start`, the ids in all shards before."""
    spark = docs.sparkSession
    system, name = file_system(where)
    system.create_dir(name)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PARTITION_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        end, width = enc.pack([end_id]), np.dtype(enc.dtype).itemsize
        keys: list[int | None] = []
        payload: list[bytes] = []
        held = shard = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, shard, keys, payload
            path = f"{where}/shard-{part:06d}-{shard:04d}"
            nulls = sum(k is None for k in keys)
            edges = np.concatenate([[0], np.cumsum([len(p) for p in payload])]) // width
            write_bytes(f"{path}.bin", b"".join(payload))
            write_bytes(f"{path}.idx", index_bytes(np.array(keys[nulls:], np.int64), nulls, edges, enc.dtype))
            ends = [keys[nulls], keys[-1]] if nulls < len(keys) else [None, None]
            row = [part, shard, path, len(keys), int(edges[-1]), *ends]
            held, shard, keys, payload = 0, shard + 1, [], []
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

        for batch in batches:
            for key, packed in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                keys.append(key)
                payload.append(packed + end)
                held += len(packed) + width
                if held >= shard_bytes or len(keys) >= SHARD_DOCS:
                    yield flush()
        if keys:
            yield flush()

    # a doc_id of very many rows is cut by the texts' beginnings, and by place where those are equal too
    begun = docs.select(F.col("doc_id").cast("long"), "text", F.substring("text", 1, 32).alias("begin"), F.monotonically_increasing_id().alias("place"))
    ordered = begun.repartitionByRange(n_parts, "doc_id", "begin", "place").sortWithinPartitions("doc_id", "text")
    manifest = stash(ordered.select("doc_id", "text").mapInArrow(run, MANIFEST), f"{where}/manifest")
    # running sums over partitions (as many as tasks), then within each
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return stash(manifest.join(before, "part").withColumn("start", F.col("before") + inner).drop("before"), f"{where}/starts")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, each found in its shard through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard.whole(path)
                distinct = np.unique(shard.keys)
                first, count = shard.records(distinct)
                records = np.concatenate([np.arange(shard.nulls), np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())])
                keys = [None] * shard.nulls + np.repeat(distinct, count).tolist()
                crc = [zlib.crc32(shard.record_ids(r).astype("<u4").tobytes()) for r in records.tolist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(keys, pa.int64()),
                        "start": pa.array(start + shard.edges[records].astype(np.int64)),
                        "n_tokens": pa.array(np.diff(shard.edges.astype(np.int64))[records]),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    spread = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return manifest.select("path", "start").repartition(int(spread)).mapInArrow(run, BACK)


def near_shards(manifest: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id and path of every shard between whose least and greatest doc_id a key lies. Shards are sorted by doc_id."""
    known = manifest.where("min_id is not null")
    if known.count() > BROADCAST_SHARDS:  # then by the keys of the indexes; payloads are not read

        def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column("path").to_pylist():
                    keys = np.unique(Shard(read_bytes(f"{path}.idx"), lambda at, n: b"").keys)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys), "path": pa.array([path] * len(keys), pa.string())})

        return known.select("path").mapInArrow(keys_of, "doc_id long, path string").join(asked, "doc_id")
    bounds = known.orderBy("part", "shard").select("part", "shard", "min_id", "max_id").toPandas()
    folder = (known.select("path").first() or [""])[0].rpartition("/")[0]
    shared = manifest.sparkSession.sparkContext.broadcast({c: bounds[c].to_numpy(np.int64) for c in bounds})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            keys = batch.column("doc_id").to_numpy(zero_copy_only=False)
            first, stop = np.searchsorted(at["max_id"], keys, "left"), np.searchsorted(at["min_id"], keys, "right")
            n = np.maximum(stop - first, 0)
            which = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            paths = [f"{folder}/shard-{p:06d}-{s:04d}" for p, s in zip(at["part"][which].tolist(), at["shard"][which].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.repeat(keys, n)), "path": pa.array(paths, pa.string())})

    return asked.mapInArrow(place, "doc_id long, path string")


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed access: keys (column doc_id) go to the shards that may hold them, and there through the index to their bytes.

    Returns doc_id and ids, a row for each record of a key; absent keys give none. A shard's keys are at most SHARD_DOCS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, wanted in zip(batch.column("path").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                system, name = file_system(f"{path}.bin")
                with system.open_input_file(name) as f:
                    shard = Shard(read_bytes(f"{path}.idx"), lambda at, n, f=f: f.read_at(n, at))
                    asked = np.array(sorted(wanted), np.int64)
                    first, count = shard.records(asked)
                    for k, start, n in zip(asked.tolist(), first.tolist(), count.tolist(), strict=True):
                        for r in range(start, start + n):
                            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([k], pa.int64()), "ids": pa.array([shard.record_ids(r).astype(np.int64)], pa.list_(pa.int64()))})

    near = near_shards(manifest, keys.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct())
    return near.groupBy("path").agg(F.collect_set("doc_id").alias("wanted")).select("path", "wanted").mapInArrow(run, "doc_id long, ids array<long>")


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Encodes, writes and reads back: the digest of every document from the files."""
    where = shared_dir(docs.sparkSession)
    return read_tokens(write_tokens(docs, tokenizer_path, where, end_id))
