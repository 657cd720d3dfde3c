import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import catalog, decontaminate, hilbert, language_id, license_scan, mixing, perfect_hash, quality_rules, simhash, suffix_dedup, token_counts, token_store
from tallyforge.llm.catalog import tokenizer
from tests.compare import assert_same, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_duckdb(spark, name):
    assert_same(catalog.queries()[name](spark, SF), duck(SF), catalog.oracle_sql()[name])


def test_license_edges(spark, edge_docs):
    got = {r.doc_id: r for r in license_scan.license_scan(edge_docs).collect()}
    assert got[10].license == "Apache-2.0" and got[10].score == 1.0 and got[3].license is None and got[3].n_lines == 0
    spread = spark.createDataFrame([(1, "Licensed under the Apache" + "\n" * 40 + "License, Version 2.0."), (2, "\n\n")], "doc_id long, text string")
    over_lines = {r.doc_id: r for r in license_scan.license_scan(spread).collect()}  # blank lines add no words to the whole text
    assert (over_lines[1].license, over_lines[1].score, over_lines[1].line, over_lines[1].n_lines) == ("Apache-2.0", 1.0, 0, 41)
    assert over_lines[2].license is None and over_lines[2].n_lines == 3 and license_scan.license_scan(spread.limit(0)).count() == 0


WRAPPED = " * Permission is hereby granted, free of charge,\n * to any person obtaining a copy of this\n * software and associated documentation files"


def test_license_passages(spark):
    """Notices wrapped over lines, inside longer lines, cut at the end and repeated, against all runs of words by brute force."""
    filler = " ".join(f"w{i}" for i in range(60))
    notices = [" ".join(license_scan.normal_words(t)) for _, t in license_scan.TEMPLATES]
    texts = [f"{filler}\n{WRAPPED}\n{filler}", f"{filler} {notices[1]} {filler}", f"{filler} Use of this source code is governed by a BSD-style license that can be", None, "", "License"]
    cut = [" ".join(n.split()[: -(-3 * len(n.split()) // 4)]) for n in notices]  # three quarters of each notice, and each with words put in
    put = [" ".join(w + (" extra word" if i % max(6, len(n.split()) // 3) == 5 else "") for i, w in enumerate(n.split())) for n in notices]
    texts += [f"{filler} {x} {filler}" for x in [*cut, *put]]
    texts += [(n.replace(" of ", " of\n") + "\n" + filler + "\n") * 3 for n in notices] + [f"{filler} " + n.replace(" license ", " licence ") for n in notices]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert (got[0].license, got[0].line, got[0].n_hits) == ("MIT", 2, 1) and got[1].score == 1.0 and got[2].license == "BSD-3-Clause"
    rows = license_scan.template_rows()
    for doc_id, text in enumerate(texts):
        lines = [license_scan.normal_words(line) for line in (text or "").split("\n")]
        words = [w for line in lines for w in line]
        pairs, best = list(zip(words, words[1:])), {}
        for name, known in rows:
            known = {tuple(k.split(" ")) for k in known}
            units = [pairs] + [list(zip(line, line[1:])) for line in lines]
            best[name] = max([best.get(name, 0), *(2 * len(set(u) & known) / (len(u) + len(known)) for u in units)])
            for i in range(len(pairs)):  # every run of every length
                met = set()
                for k in range(i, min(len(pairs), i + 2 * len(known))):
                    met |= {pairs[k]} & known
                    best[name] = max(best[name], 2 * len(met) / (k - i + 1 + len(known)))
        assert got[doc_id].licenses == ",".join(sorted(n for n, s in best.items() if round(s, 9) >= license_scan.THRESHOLD)), doc_id
        assert abs((got[doc_id].score or 0) - max([s for s in best.values() if round(s, 9) >= license_scan.THRESHOLD], default=0)) < 1e-8


# op1


def token_digests(pairs, path, end):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_tokens_round_trip(spark, docs):
    path = tokenizer("word_bpe_49k.json")
    assert rows(token_store.token_ids(docs, path)) == token_digests(rows(docs, "doc_id", "text"), path, 2)


def test_tokens_edges(spark, edge_docs):
    path = tokenizer("word_bpe_49k.json")
    assert rows(token_store.token_ids(edge_docs, path)) == sorted(token_digests(rows(edge_docs, "doc_id", "text"), path, 2), key=lambda r: tuple((x is not None, x) for x in r))
    assert token_store.token_ids(edge_docs.limit(0), path).count() == 0


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_tokens_lookup(spark, docs, tmp_path, monkeypatch, limit):
    """Against a scan: one doc_id fills several shards, some have several rows, null and absent ones give none."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "BROADCAST_SHARDS", limit)
    path, hot = tokenizer("word_bpe_49k.json"), F.when(F.col("doc_id") % 3 == 0, 30).when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("doc_id") - F.col("doc_id") % 2)
    many = docs.withColumn("doc_id", hot)
    manifest = token_store.write_tokens(many, path, f"file://{tmp_path}/t", 2, shard_bytes=1 << 14)
    asked = [30, 76, 82, 100, 10**9, -5]
    got = token_store.lookup(manifest, spark.createDataFrame([(k,) for k in [*asked, None, 30]], "doc_id long"))
    library = Tokenizer.from_file(path)
    want = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows(many, "doc_id", "text") if i in asked]
    assert manifest.where("min_id = 30 and max_id = 30").count() > 1 and sorted((r.doc_id, r.ids) for r in got.collect()) == sorted(want) and len(want) > 60


def test_a_hot_doc_id_is_cut(spark, docs, tmp_path):
    one = docs.withColumn("doc_id", F.lit(7)).withColumn("text", F.lit("the same text for all"))
    manifest = token_store.write_tokens(one, tokenizer("word_bpe_49k.json"), f"file://{tmp_path}/t", 2)
    assert manifest.select("part").distinct().count() > 1 and manifest.agg(F.sum("n_docs")).first()[0] == docs.count()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "Thing", "ing.", " ", "\n", ".", ",", "É", "é", "日", "<|endoftext|>", "<|EndOfText|>", "12", "'s", "'", "!!", "\xa0", "İ", "Σ"]), max_size=12))
def test_encoder_is_the_library(parts):
    enc, text = token_store.encoder(tokenizer("word_bpe_49k.json")), "".join(parts)
    assert list(enc.encode([text])) == [enc.pack(enc.tokenizer.encode(text, add_special_tokens=False).ids)]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    table = perfect_hash.PerfectHash.build(keys)
    assert sorted(table.find(keys)) == list(range(len(keys)))
    assert (table.find(keys + 1) >= 0).mean() < 0.001


# op3


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab the.,!|\n 1<>▁é日\x00")), max_size=40))
def test_counts_are_the_library(text):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    assert token_counts.counter(path).count(text) == len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))


def test_counts(spark, docs, edge_docs):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (docs, edge_docs):
        want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in rows(df, "doc_id", "text")]
        assert rows(token_counts.token_counts(df, path)) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


# op4


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines
        lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n\t#é\x0b\x85")), max_size=120))
def test_stats(text):
    assert quality_rules.text_stats(text)[:5] == brute_stats(text)


def test_quality(spark, edge_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    q = catalog.op4_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    good, bad = q.where("quality = 1 and not base_failed"), q.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count() and bad.where("not kept").count() >= 0.9 * bad.count()
    got = quality_rules.quality(edge_docs, labels.limit(0))
    assert got.where("kept = base_failed").count() == 0 and got.count() == edge_docs.count()


# op5


def test_language(spark, edge_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    assert language_id.held_out() is not None and docs.where(language_id.held_out()).count() == sum(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs.select("doc_id").collect())
    edge = {r.doc_id: r for r in language_id.language_id(edge_docs).collect()}
    assert edge[3].lang_pred == edge[4].lang_pred == edge[9].lang_pred == "und" and edge[8].lang_pred != "und"
    none = language_id.language_id(edge_docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.where("lang_pred <> 'und'").count() == 0 and language_id.language_id(edge_docs.limit(0)).count() == 0


def test_tables_are_the_convolution():
    rng = np.random.default_rng(3)
    net = language_id.Net.new(["a", "b"], rng)
    x = rng.integers(0, 256, (3, language_id.LENGTH)).astype(np.uint8)
    pooled = []
    for w, f, b in zip(language_id.WIDTHS, net.filters, net.bias, strict=True):
        places = [net.embedding[x[:, i : i + w]].reshape(3, -1) @ f + b for i in range(language_id.LENGTH - w + 1)]
        pooled.append(np.max(places, 0))
    logits = np.maximum(np.concatenate(pooled, 1), 0) @ net.dense + net.dense_bias
    logits -= np.log(np.exp(logits).sum(1, keepdims=True))
    assert np.allclose(net.log_probabilities(x, net.tables()), logits, atol=1e-4)


# op6


def test_mixing(spark, edge_docs):
    got = mixing.mix(edge_docs)
    assert got.count() == edge_docs.count() and got.where("n_tokens = 0 and kept").count() == 0 and mixing.mix(edge_docs.limit(0)).count() == 0


# op7

SPLIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_contamination(docs, items):
    lower = lambda t: SPLIT.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    out = []
    for doc_id, text in docs:
        w, hit, found, near = lower(text), set(), set(), set()
        held = [set(w[i : i + decontaminate.SPAN]) for i in range(len(w))]
        for item_id, item in items:
            v = lower(item)
            n = min(13, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                if any(h.issuperset(v[k : k + n]) for h in held):
                    near.add("" if item_id is None else str(item_id))
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[k : k + n]:
                        hit |= set(range(i, i + n))
                        found.add("" if item_id is None else str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w), len(near)))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def test_decontamination(spark):
    rng = random.Random(5)
    words = ["ab", "cd", "ef", "g1", "é", "hi"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 13, 14, 30]))) for i in range(12)] + [(3, text(20)), (None, text(13)), (50, None), (51, "--")]
    pairs = [(i, (text(rng.randint(0, 60)) + ". " + (rng.choice(items)[1] or "")).upper()) for i in range(40)] + [(7, text(9)), (None, text(30)), (90, None), (91, "")]
    pairs.append((92, text(6_000)))
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate.contamination(docs, bench)) == brute_contamination(pairs, items)
    clash = [docs.withColumns({c: F.lit("clash") for c in ("row", "term", "pos", "words", "item", "n_hit")}), bench.withColumns({c: F.lit("clash") for c in ("item", "words", "off", "len")})]
    assert rows(decontaminate.contamination(*clash)) == rows(decontaminate.contamination(docs, bench))
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0 or n_near > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_proximity(spark):
    """Shuffled passages of many words, of which few other documents have any."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 13, 16])))) for i in range(30)]
    loose = lambda t: " ".join(x for w in rng.sample(t.split(), len(t.split())) for x in ([w] if rng.random() < 0.6 else [w, rng.choice(vocabulary)]))
    pairs = [(i, " ".join(rng.choices(vocabulary, k=30)) + " " + loose(rng.choice(items)[1]) + " and " + " ".join(rng.choices(vocabulary, k=30))) for i in range(120)]
    got = rows(decontaminate.contamination(spark.createDataFrame(pairs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute_contamination(pairs, items) and sum(r[6] for r in got) > 30 and sum(r[6] for r in got) > sum(r[3] for r in got)


def test_items_that_share_passages(spark, monkeypatch):
    """Boilerplate of many items: every item is found, whether a document has only the boilerplate or more; places do not multiply with the items."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    some = lambda n: rng.choices(vocabulary, k=n)
    shared = some(18)
    items = [(i, " ".join([*some(i % 4), *shared, *some(i % 5)])) for i in range(40)] + [(100 + i, " ".join(some(20))) for i in range(10)] + [(200, items[3][1]) for items in [[(0, " ".join(shared))] * 4]]
    pairs = [(i, " ".join([*some(30), *(shared if i % 2 else shared[:12]), *some(20)])) for i in range(20)] + [(50 + i, " ".join([*some(10), items[i][1], *some(10)])) for i in range(0, 50, 5)]
    written, real = {}, decontaminate.stash
    monkeypatch.setattr(decontaminate, "stash", lambda df, where, **k: written.setdefault(where.rsplit("/", 1)[-1], real(df, where, **k)))
    got = rows(decontaminate.contamination(spark.createDataFrame(pairs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute_contamination(pairs, items) and max(r[3] for r in got) >= 40
    assert written["places"].count() < 20 * len(pairs)  # the items that share the passage are 40


@pytest.mark.parametrize("limit", [0, 500_000])
def test_decontamination_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = decontaminate.contamination(docs, bench)
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 3000]
    known = {r[0] for r in pairs}
    want = brute_contamination(pairs, [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert [r for r in rows(got) if r[0] in known] == want


# op8


def test_hilbert(spark, docs, edge_docs):
    cells = hilbert.curve(spark, 3).orderBy("curve_index").toPandas()
    assert cells["curve_index"].tolist() == list(range(4096)) and np.abs(np.diff(cells[["d0", "d1", "d2"]].to_numpy(), axis=0)).sum(1).max() == 1
    for df in (docs, edge_docs):
        got = hilbert.shards(df).toPandas()
        counts = got.groupby("shard").size()
        assert len(got) == df.count() and counts.max() - counts.min() <= 1 or len(got) < 16
        assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    text = {i: (t or "").encode() for i, t in rows(docs, "doc_id", "text")}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in hilbert.shards(docs).select("doc_id", F.col("size"), "text_crc32").toPandas().itertuples(index=False) for r in [type("R", (), dict(doc_id=r[0], size=r[1], text_crc32=r[2]))])
    assert hilbert.shards(docs.limit(0)).count() == 0


def test_shards_are_runs_of_the_sorted_curve(docs, edge_docs):
    """Against a sorted list cut into runs of equal count."""
    for df in (docs, edge_docs):
        got = hilbert.shards(df).toPandas()
        place = {tuple(r[:3]): r[3] for r in hilbert.curve(df.sparkSession, 3).collect()}
        cell = lambda v: zlib.crc32(v.encode()) % 16 if v is not None else 0
        raw = [(i, (t or "").encode(), lang, source) for i, t, lang, source in rows(df, "doc_id", "text", "lang", "source")]
        keys = sorted((place[cell(lang), cell(source), min(15, (len(t) + 1).bit_length() - 1)], zlib.crc32(t), i is not None, i or 0) for i, t, lang, source in raw)
        n, more = divmod(len(keys), 16)
        cuts = [(k, s) for k in range(16) for s in range(n + (k < more))]
        want = [(*at, c, crc, i if has else None) for at, (c, crc, has, i) in zip(cuts, keys, strict=True)]
        assert sorted(got[["shard", "slot"]].itertuples(index=False, name=None)) == cuts
        mine = got.sort_values(["shard", "slot"])
        assert [(*r[:4], None if r[4] != r[4] else r[4]) for r in mine[["shard", "slot", "curve_index", "text_crc32", "doc_id"]].itertuples(index=False, name=None)] == want


def test_written_shards_prune(spark, edge_docs, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hilbert.write_shards(docs, f"file://{tmp_path}/s")
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert rows(back, *docs.columns) == rows(docs) and back.groupBy("shard", "slot").count().where("count > 1").count() == 0
    held = back.select("shard", "lang", "source", F.floor(F.log2(F.octet_length("text") + 1)).alias("size")).distinct().toPandas()
    for by in (["lang"], ["source"], ["lang", "source"], ["size"]):  # files that a search for one value must read, of 16
        assert held.groupby(by)["shard"].nunique().mean() < {"lang": 9, "source": 12, "size": 16}[by[0]] - 5 * (len(by) - 1)
    hilbert.write_shards(edge_docs, f"file://{tmp_path}/e")
    edge = spark.read.parquet(f"file://{tmp_path}/e")
    assert edge.count() == edge_docs.count() and edge.where("doc__shard = 'clash' and rank = 'clash' and text is null").count() == 1


# op9


def brute_dedup(pairs):
    own, out = {}, []
    for doc_id, text in pairs:
        raw = (text or "").encode()
        for k in range(len(raw) - 49 if doc_id is not None else 0):
            own[raw[k : k + 50]] = min(own.get(raw[k : k + 50], doc_id), doc_id)
    for doc_id, text in pairs:
        raw = (text or "").encode()
        cut = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49 if doc_id is not None else 0):
            if own[raw[k : k + 50]] < doc_id:
                cut[k : k + 50] = True
        spans = int((cut & ~np.append(False, cut[:-1])[: len(cut)]).sum())
        out.append((doc_id, len(raw), int(cut.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~cut].tobytes()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize(("batch_bytes", "hot", "step"), [(6 << 20, 4096, 1 << 18), (3000, 4096, 1 << 18), (3000, 2, 64)])
def test_suffix_dedup(spark, monkeypatch, batch_bytes, hot, step):
    monkeypatch.setattr(suffix_dedup, "STEP", step)
    rng = random.Random(3)
    pieces = ["".join(rng.choice("abcde ") for _ in range(rng.randint(30, 200))) for _ in range(12)]
    pieces += ["ab" * 60, "x" * 120, "abcabcabd" * 15, "ab" * 20, "abcdefghijklm" * 3 + "Z", "abcdefghijklm" * 5, "mno" * 9, "é" * 20, ""]
    pairs = [(None if i % 17 == 3 else i, None if i % 11 == 4 else "".join(rng.choice(pieces)[rng.randint(0, 30) :] for _ in range(rng.randint(0, 6)))) for i in range(120)]
    pairs += pairs[:5]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(7)
    got = suffix_dedup.suffix_dedup(df, batch_bytes, hot)
    assert rows(suffix_dedup.digests(got)) == brute_dedup(pairs)
    for r in got.join(df, "doc_id").where("text is not null").collect():  # kept bytes and removed spans make up a text
        if sum(i == r.doc_id for i, _ in pairs) == 1:
            raw, spans = r.text.encode(), [tuple(x) for x in r.removed]
            assert bytes(r.kept) == b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)], strict=True))


def test_suffix_dedup_of_periodic_texts(spark):
    """Strings whose first and last bytes and a stretch at different places agree are not one string."""
    rng = random.Random(5)
    words = ["of ", "a ", "du ", "de ", "x", "ab", "abcab", "Q", "of a ", "abcdefghijklmnopqrstuvwxy", "abcdefghijklmnopqrstuvwxyz0"]
    pairs = [(rng.randint(1, 300), "".join(rng.choice(words) * rng.randint(1, 40) for _ in range(rng.randint(0, 7)))) for _ in range(400)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    assert rows(suffix_dedup.digests(suffix_dedup.suffix_dedup(df, 20_000))) == brute_dedup(pairs)


@pytest.mark.parametrize("block", [40, 1 << 15])
def test_cells_have_the_first_least_hash(monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab", "x", "of ", "Qed"]) * rng.randint(1, 60) for _ in range(rng.randint(0, 4))).encode() for _ in range(50)]
    skip = np.arange(len(texts)) % 7 == 3
    cells = suffix_dedup.Cells(texts, skip)
    got = {}
    for first, count, lead, doc, own in zip(*(x.tolist() for x in (cells.first, cells.count, cells.lead, cells.doc, cells.hash)), strict=True):
        start = first - int(cells.ends[doc] - cells.sizes[doc])
        got |= {(doc, start + k): (lead - k % (lead + 1), own) for k in range(count)}
    want = {}
    for doc, text in enumerate(texts):
        h = suffix_dedup.gram_hashes(np.frombuffer(text, np.uint8)).tolist() if len(text) >= 50 else []
        for k in range(0 if skip[doc] else len(text) - 49):
            lead = min(range(suffix_dedup.SPAN), key=lambda d: h[k + d] >> 32)
            want[doc, k] = lead, h[k + lead]
    assert got == want


def test_cells_are_found_in_the_cache():
    """Arrays of many megabytes, written and read again for each step of the hash, cost most of op9's CPU time."""
    import tracemalloc

    text = np.random.default_rng(1).integers(97, 123, 4 << 20, np.uint8).tobytes()
    texts = [text[a : a + 2048] for a in range(0, len(text), 2048)]
    tracemalloc.start()
    suffix_dedup.Cells(texts, np.zeros(len(texts), bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 9 * len(text)  # the cells themselves, which are one for 14 bytes


def test_suffix_dedup_edges(spark, edge_docs):
    assert rows(suffix_dedup.digests(suffix_dedup.suffix_dedup(edge_docs))) == brute_dedup(rows(edge_docs, "doc_id", "text"))
    assert suffix_dedup.suffix_dedup(edge_docs.limit(0)).count() == 0


def test_texts_are_shuffled_once(spark, docs):
    plan = suffix_dedup.suffix_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(batch") == 1 and "Bucketed: true" in plan  # what came back, not the texts


PERIODIC = """
import resource, sys
sys.path.insert(0, {root!r})
import pyarrow as pa
from tallyforge.llm import suffix_dedup as s
docs = pa.table({{"doc_id": [1, 2], "text": ["ab" * (5 << 20), "xy" + "ab" * 1000], "batch": pa.array([0, 0], pa.int32())}})
sent = s.send_anchors(4)(docs)
groups = lambda t, by: [t.filter(pa.compute.equal(t[by], k)) for k in pa.compute.unique(t[by]).to_pylist()]
shared = pa.concat_tables([s.shared_anchors(4096)(g) for g in groups(sent, "bucket")])
units = s.send_units(4)(docs, shared)
back = pa.concat_tables([shared, *[s.sort_buckets(g) for g in groups(units, "bucket")]])
out = s.settle(docs, back).to_pylist()
assert [len(r["kept"]) for r in out] == [10 << 20, 2] and out[1]["removed"] == [{{"start": 2, "end": 2002}}], [len(r["kept"]) for r in out]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


def test_periodic_text_is_bounded():
    import subprocess
    import sys
    from pathlib import Path

    done = subprocess.run([sys.executable, "-c", "import pyarrow.compute\n" + PERIODIC.format(root=str(Path(__file__).parents[2]))], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 1000  # MB at its most, for 10 MB of text


# op10


def brute_components(pairs):
    fps = [(i, simhash.fingerprint(t)) for i, t in pairs]
    root = list(range(len(fps)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(fps)):
        for b in range(a):
            if ((fps[a][1] ^ fps[b][1]) & (2**64 - 1)).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, f"{f % 2**64:016x}", least.get(find(k))) for k, (i, f) in enumerate(fps)), key=lambda r: tuple((x is not None, x) for x in r))


def test_simhash(spark, docs, edge_docs):
    for df in (docs, edge_docs):
        assert rows(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id") == brute_components(rows(df, "doc_id", "text"))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_of_a_large_group(spark, tmp_path):
    """Fingerprints within a few bits of one centre: every bucket is full of them, and no link may be lost."""
    rng = np.random.default_rng(2)
    fps = np.unique([np.bitwise_xor.reduce(np.append(1 << rng.choice(62, rng.integers(0, 4), replace=False), 0x1234)) for _ in range(3000)])
    classes = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    plan = simhash.plan_for(classes, len(fps))
    got = {tuple(r) for r in simhash.links(classes, plan, f"file://{tmp_path}").collect()}
    near = np.bitwise_count((fps[:, None] ^ fps).astype(np.uint64))
    want = {(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero((near > 0) & (near <= 2)), strict=True)}
    assert got == want
