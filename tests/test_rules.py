"""One case a rule of the mining registry, with the pattern's id, category and surface as the reference states them."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import graph, mining, verifiers

CAND = "run_id string, proposer_id long, task_id string, status string, error string, finish_reason string, diff_files array<string>"
VERIFY = "run_id string, proposer_id long, verify_status string, exit_code int, apply_error string, band_failed array<string>"
RUN, SELECT = "run_id string, task_files array<string>, instruction string, configured int", "run_id string, selected long, also_passed array<string>"
DRIFT = "error: No such file or directory\nerror: a.go: patch does not apply"


def fired(spark, status="ok", error=None, finish="stop", files=("a.go",), verify=None, exit_code=1, apply=None, bands=(), others=(), instruction="Fix it.", selected=None, also=()):
    cand = [("r", 0, "t", status, error, finish, list(files))] + [("r", i + 1, "t", "ok", None, "stop", ["a.go"]) for i in range(len(others))]
    ver = [("r", 0, verify, exit_code, apply, list(bands))] if verify else []
    ver += [("r", i + 1, v, 1, None, []) for i, v in enumerate(others)]
    frames = [spark.createDataFrame(x, s) for x, s in ((cand, CAND), (ver, VERIFY), ([("r", ["a.go"], instruction, 0)], RUN), ([("r", selected, list(also))], SELECT))]
    got = mining.observations(mining.joined(*frames)).where("proposer_id = 0").collect()
    return {r.rule: (r.slug, r.category, r.component, r.task, r.key) for r in got}


CASES = {
    "R1": (dict(status="no_diff", files=()), ("no-diff-emitted", "not-provided", "system-prompt", None, "")),
    "R2": (dict(status="malformed", files=()), ("non-completion-response", "not-provided", "tool-description", None, "")),
    "R3": (dict(verify="apply_failed", apply=DRIFT), ("context-lines-drift", "unsafe-provided", "memory", "t", "")),
    "R4": (dict(verify="apply_failed", apply="error: corrupt patch at line 7"), ("malformed-hunk", "unsafe-provided", "memory", "t", "")),
    "R5": (dict(verify="apply_failed", apply="error: a.go: already exists in index"), ("out-of-scope-path", "unsafe-provided", "memory", "t", "")),
    "R6": (dict(verify="fail", others=("pass",), selected=1), ("task-specific-knowledge-gap", "unsafe-provided", "memory", "t", "")),
    "R7": (dict(verify="fail", others=("fail",)), ("instruction-underspecified", "not-provided", "memory", "t", "")),
    "R8": (dict(status="timeout", files=()), ("proposer-budget-exceeded", "wrong-duration", "middleware", None, "")),
    "R9": (dict(verify="timeout"), ("verify-budget-exceeded", "wrong-duration", "middleware", "t", "")),
    "R10": (dict(finish="length", verify="pass"), ("completion-truncated", "wrong-duration", "system-prompt", None, "")),
    "R11": (dict(files=("a.go", "z.go"), verify="pass"), ("edits-unlisted-file", "unsafe-provided", "system-prompt", "t", "")),
    "R12": (dict(files=("a.go", "b_test.go"), verify="pass", instruction="Use the latest version."), ("edits-the-tests", "unsafe-provided", "system-prompt", "t", "")),
    "R13": (dict(verify="pass", others=("fail",), selected=0), ("single-proposer-dependence", "not-provided", "subagent-config", "t", "")),
    "R14": (dict(verify="fail", exit_code=0, bands=("x", "x")), ("persistent-band-breach", "wrong-timing", "middleware", "t", "x")),
    "R16": (dict(status="http_error", error="llm: HTTP 413: too big", files=()), ("request-rejected-by-server", "unsafe-provided", "system-prompt", None, "payload-too-large")),
}


@pytest.mark.parametrize("rule", CASES)
def test_rule(spark, rule):
    arguments, want = CASES[rule]
    got = fired(spark, **arguments)
    assert got[rule] == want and set(got) - {rule} <= {"R11"} - ({rule} if rule != "R12" else set())


def test_what_does_not_fire(spark):
    assert fired(spark, verify="apply_failed", apply="context of a malformed hunk") == {}
    assert "R12" not in fired(spark, files=("b_test.go",), instruction="Repair b_test.go") and "R12" not in fired(spark, files=("b_test.go",), instruction="Add tests")
    assert fired(spark, status="http_error", error="read tcp: reset after 404 bytes", files=()) == {} and fired(spark, status="http_error", error="HTTP 503: exceeds", files=()) == {}
    assert "R7" not in fired(spark, verify="fail", others=("apply_failed",)) and "R13" not in fired(spark, verify="pass", others=("pass",), selected=0, also=("1",))


def test_reasons(spark):
    said = {"HTTP 400: prompt is too long": "context-length", "HTTP 400 n_ctx 4096": "context-length", "HTTP 429": "rate-limited", "HTTP 403: no": "not-authorised", "HTTP 418": "http-418",
            "HTTP 500": None, "dial tcp: connection refused": None, "got 404 bytes": None}
    got = spark.createDataFrame([(k,) for k in said], "e string").select("e", text.http_reason(F.col("e")).alias("r"))
    assert {r.e: r.r for r in got.collect()} == said


def test_run_ids(spark):
    ids = ["run/he-0001@2026-09-05-gpt-oss-20b-in", "run/he-0001@2026-09-05-Gpt-in", "run/he-0001@2026-09-05-a--b-out", "run/he-0001@2026-09-05-m.1-out-2"]
    got = spark.createDataFrame([(i,) for i in ids], "s string").select(text.run_id_parts(F.col("s")).alias("p")).collect()
    assert [r.p and (r.p.model, r.p.side, r.p.seq) for r in got] == [("gpt-oss-20b", "in", None), None, None, ("m.1", "out", 2)]


def bands(spark, rows, **options):
    obs = spark.createDataFrame([(n, float(v), 0.0, float(lo), float(hi)) for n, values, lo, hi in rows for v in values], "name string, value double, ci_half double, band_lo double, band_hi double")
    return {r["name"]: r for r in verifiers.derive_bands(obs, "name", **options).collect()}


def test_bands_in_order(spark):
    wide = [9.5, 10.5, 10.0, 10.2, 9.8]
    got = bands(spark, [("kept", wide, 0, 1), ("inside", wide, 9, 11), ("count", [3, 4, 5, 4, 4], 0, 1), ("few", wide[:4], 0, 1), ("zero", [0.0] * 5, 1, 2), ("t_ms", [0.0] * 5, 1, 2), ("own", wide, 0, 1)], keep=("kept",))
    assert {k: r.why for k, r in got.items()} == {"kept": "declared", "inside": "in-band", "count": "quantised", "few": "no-factor", "zero": "quantised", "t_ms": "quantised", "own": "derived"}
    assert (got["kept"].lo, got["kept"].hi, got["inside"].lo) == (0, 1, 9) and got["few"].lo is None and got["own"].binding == "k*stddev" and got["own"].holds_own
    assert {k: r.why for k, r in bands(spark, [("zero", [0.0] * 5, 1.5, 2), ("t_ms", [0.0] * 5, 1.5, 2)]).items()} == {"zero": "no-width", "t_ms": "derived"}
    low = {policy: bands(spark, [("x", [1.0, 9.0, 5.0, 4.5, 5.5], 0.5, 1)], lower=policy)["x"] for policy in ("derive", "zero", "keep")}
    assert low["derive"].lo < 0 and low["zero"].lo == 0 and low["keep"].lo == 0.5 and {r.lower_policy for r in low.values()} == {"derive", "zero", "keep"}


def test_conflicting_clauses(spark):
    nodes = spark.createDataFrame([("a", "clause", "accepted", "MAY"), ("b", "clause", "accepted", "SHOULD_NOT"), ("c", "clause", "accepted", "MUST_NOT"), ("d", "clause", "proposed", "MUST")], "id string, kind string, status string, modality string")
    edges = spark.createDataFrame([(x, "t", "about") for x in "abcd"] + [("a", "b", "excepts"), ("a", "c", "excepts")], "src string, dst string, name string")
    assert graph.modality_conflicts(nodes, edges).count() == 0
    got = {tuple(r) for r in graph.modality_conflicts(nodes, edges.where("dst <> 'b'")).collect()}
    assert got == {("t", "a", 1), ("t", "b", 1)}
    assert [tuple(r) for r in graph.strict_exceptions(nodes, edges).collect()] == [("a", "c", "MUST_NOT")]
