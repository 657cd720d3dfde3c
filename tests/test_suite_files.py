import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import graph, ordering, sequential
from tallyforge.sources import readers


def put(root, path, record):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(record if isinstance(record, str) else json.dumps(record, indent=1))


def test_suite_with_and_without_gold(spark, tmp_path):
    put(tmp_path, "suite.json", {"schema_version": 1, "id": "s", "split": "held-in", "tasks": [{"id": "a"}, {"id": "b", "dir": "x", "gold": "g.json"}, {"id": "c"}]})
    put(tmp_path, "a/gold.json", {"gold": "b", "judgments_used": 3})
    put(tmp_path, "x/g.json", {"gold": "tie", "hard": True})
    got = {r.item: r.gold for r in readers.suite_items(spark, f"{tmp_path}/suite.json").collect()}
    assert got["a"].gold == "b" and got["b"].hard and got["c"] is None
    for bad in ({"id": "s", "schema_version": 2, "tasks": [{"id": "a"}]}, {"id": "s", "schema_version": 1, "tasks": []}, {"id": "s", "schema_version": 1, "tasks": [{"id": "a"}, {"id": "a"}]}):
        put(tmp_path, "bad.json", bad)
        with pytest.raises(Exception, match="malformed suite"):
            readers.suite_items(spark, f"{tmp_path}/bad.json").collect()


def test_judge_runs_and_their_calls(spark, tmp_path):
    call = {"first": "a", "second": "b", "choice": "first", "status": "ok"}
    put(tmp_path, "r1/judge.json", {"outcome": {"kind": "selected", "candidate_id": "a"}, "pairs": [{"pair": ["a", "b"], "orders": [call, call], "verdict": "a"}], "latency_ms": 7})
    put(tmp_path, "r2/judge.json", {"outcome": {"kind": "failed"}, "consensus": {"agreement": "exact"}})
    runs = readers.judge_runs(spark, str(tmp_path))
    assert {(r.run_id, r.outcome, r.candidate, r.consensus, r.latency_ms) for r in runs.collect()} == {("r1", "selected", "a", None, 7), ("r2", "failed", None, "exact", 0)}
    assert [(r.ord, r.choice) for r in readers.judge_orders(runs).orderBy("ord").collect()] == [(0, "first"), (1, "first")]
    put(tmp_path, "r3/judge.json", {"outcome": {"kind": "selected"}, "pairs": [{"pair": ["a"]}]})
    with pytest.raises(Exception, match="malformed judge record"):
        readers.judge_runs(spark, str(tmp_path)).collect()


def test_reports_results_and_bands(spark, tmp_path):
    put(tmp_path, "d/r.json", {"schema_version": 1, "run_id": "x", "task": "t", "runs": [{"label": "ref", "kind": "reference", "status": "pass"}, {"kind": "mutant", "status": "fail"}]})
    assert [(r.kind, r.status) for r in readers.doctor_runs(spark, f"{tmp_path}/d").orderBy("place").collect()] == [("reference", "pass"), ("mutant", "fail")]
    put(tmp_path, "d/r.json", {"schema_version": 1, "run_id": "x", "runs": []})
    with pytest.raises(Exception, match="malformed report"):
        readers.doctor_runs(spark, f"{tmp_path}/d").collect()
    printed = lambda s: spark.createDataFrame([(s,)], "s string").select(readers.verify_result(F.col("s")).alias("r")).first().r
    assert printed('{"schema_version": 1, "status": "timeout", "new": 1}').status == "timeout"
    for bad in ("", " ", None, "no", '{"schema_version": 2, "status": "pass"}', '{"schema_version": 1, "status": "fine"}'):
        with pytest.raises(Exception, match="malformed verify result"):
            printed(bad)
    put(tmp_path, "band.csv", "invariant,value,ci_half,band_lo,band_hi,verdict\np99,2.5,,0,2,fail\nq,,,,,skipped\n")
    assert [(r.invariant, r.value, r.ci_half, r.verdict) for r in readers.band_rows(spark, f"{tmp_path}/band.csv").collect()] == [("p99", 2.5, None, "fail"), ("q", None, None, "skipped")]
    put(tmp_path, "m/a.md", "---\nid: x\n---\nbody")
    put(tmp_path, "m/b.md", "no head")
    assert [r.path.rsplit("/", 1)[1] for r in graph.missing_heads(readers.frontmatter(spark, f"{tmp_path}/m")).collect()] == ["b.md"]


def test_identifiers_paths_and_seeds(spark):
    def fnv(task, repeat):
        h = 0xCBF29CE484222325
        for octet in task.encode() + b"\0" + str(repeat).encode():
            h = (h ^ octet) * 0x100000001B3 % 2**64
        return h % 2**63

    rows = [("", 0), ("abc", 12), ("é日", -3)]
    got = spark.createDataFrame(rows, "t string, r int").select("t", "r", text.fnv_seed(F.col("t"), F.col("r")).alias("seed")).collect()
    assert all(r.seed == fnv(r.t, r.r) for r in got)
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.verifier_id_parts(F.lit("verifier/a-b@2026-02-30"))) is None and one(text.verifier_id_parts(F.lit("verifier/a-b@2026-02-28-2"))).seq == 2
    assert one(text.edit_number(F.lit("he-0042"))) == 42 and one(text.edit_number(F.lit("he-42"))) is None and one(text.pattern_slug(F.lit("fp/a-b"))) == "a-b"
    paths = {"/w/s/r1": "r1", "/w/x/r2": "x/r2", "/w/s": ".", "/other/r3": "r3", "": "", "/ws/r": "r"}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", text.record_path(F.col("p"), ["/w/s", "/w"]).alias("x")).collect()
    assert {r.p: r.x for r in got} == paths
    assert one(text.scrub(F.lit("no /w/s/a.go in /home/u/b"), ["/w/s/", "/"], "/home/u")) == "no a.go in ~/b"


def test_running_sums_over_any_ranges(spark, monkeypatch):
    """Few ranges and more than rows give the same; nulls and single rows too."""
    rows = [(s, i, None if i % 7 == 0 else (i * 5) % 3 - 1) for s in ("held-in", "held-out") for i in range(60)] + [("none", 1, None)]
    pairs = spark.createDataFrame(rows, "split string, pair_id int, outcome int")
    want = {(s, i): sum(o == 1 for t, k, o in rows if t == s and k <= i) for s, i, _ in rows}
    for rows_per_task in (1, 40, 1000):
        monkeypatch.setattr(ordering, "ROWS_PER_TASK", rows_per_task)
        got = sequential.running_sums(pairs, "pair_id", {"b": F.coalesce(F.col("outcome") == 1, F.lit(False))}).collect()
        assert {(r.split, r.pair_id): r.b for r in got} == want and len(got) == len(rows)
    assert sequential.running(pairs.limit(0)).count() == 0
