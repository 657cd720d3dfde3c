import json

from pyspark.sql import functions as F

from tallyforge.operators import mining
from tallyforge.sources import readers

RUNS = ["20260905T012345Z-a1b2c3d4", "20260906T012345Z-0000abcd"]


def test_trace_tree_to_patterns(spark, tmp_path):
    """Run directories with candidates, verifications and selections are read and mined."""

    def put(path, **record):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(json.dumps(record, indent=1))

    for run in RUNS:
        put(f"{run}/run.json", schema_version=1, run_id="", task={"id": "t", "files": ["a.go"]}, proposers=[{"id": "p", "model": "m"}, {"id": "q", "model": "m"}])
        put(f"{run}/candidates/p.json", proposer_id="p", model="m", status="ok", finish_reason="stop", usage={"prompt_tokens": 5}, diff={"files": ["a.go", "b.go"]})
        put(f"{run}/candidates/q.json", status="no_diff", model="n")
        put(f"{run}/verify/p/result.json", status="fail", exit_code=1, band={"failed": ["x"], "rows": [{"invariant": "x", "value": 2.5, "band_hi": 2}]})
    put(f"{RUNS[0]}/select.json", selection={"kind": "no_candidate"}, also_passed=None)
    put("notes/candidates/z.json", status="ok")  # not in a run directory
    root = str(tmp_path)
    cand, ver, sel = readers.candidates(spark, root), readers.verifies(spark, root), readers.selections(spark, root)
    assert {(r.run_id, r.proposer_id, r.status, r.prompt_tokens, tuple(r.diff_files)) for r in cand.collect()} == {
        x for run in RUNS for x in ((run, "p", "ok", 5, ("a.go", "b.go")), (run, "q", "no_diff", 0, ()))}
    assert [(r.candidate_id, r.band_rows[0].value) for r in ver.collect()] == [("p", 2.5)] * 2
    assert [(r.run_id, r.kind, r.selected, r.also_passed) for r in sel.collect()] == [(RUNS[0], "no_candidate", None, [])]
    runs = readers.trace_runs(spark, [root], readers.TRACE_RUN)
    runs = runs.select("run_id", F.col("task.id").alias("task_id"), F.col("task.files").alias("task_files"), F.lit("Fix it.").alias("instruction"), F.size("proposers").alias("configured"))
    rows = mining.joined(cand.join(runs.select("run_id", "task_id"), "run_id"), ver.drop("error", "candidate_id"), runs.drop("task_id"), sel)
    assert mining.observations(rows).where("rule = 'R7'").count() == 1  # one run has a selection that says so
    got = {(r.rule, r.task, r.key, r.runs) for r in mining.buckets(mining.observations(rows)).collect()}
    assert got == {("R1", None, "", 2), ("R11", "t", "", 2), ("R14", "t", "x", 2)}
