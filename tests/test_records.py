"""Edge cases of the record operators and the sinks."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import matching, pairwise, sequential, trials, validity, verifiers
from tallyforge.plans import catalog
from tallyforge.sources import readers, writers

JUDGED = "outcome string, consensus string, reason string, tie_break string"


def test_rules_in_order(spark):
    rows = [("selected", "all", "condorcet x", None), ("selected", "", "condorcet x", "short"), ("selected", None, "copeland", "short"),
            ("selected", None, "copeland x", ""), ("selected", None, None, None), ("no_candidate", "all", None, None)]
    got = spark.createDataFrame(rows, JUDGED).select(validity.rule(*(F.col(c) for c in ("outcome", "consensus", "reason", "tie_break"))).alias("r"))
    assert [r.r for r in got.collect()] == ["consensus", "condorcet", "tie_break", "copeland", "unstated", None]


def test_standing_without_comparison_or_rows(spark):
    schema = "id string, window_to date, human_kappa double, verdict string"
    empty = validity.standing(spark.createDataFrame([], schema), "2026-02-01").first()
    assert (empty.binding, empty.never_compared, empty.nothing_binds, empty.stale) == (0, True, True, False)
    rows = spark.sql("SELECT 'a' id, date'2026-01-20' window_to, cast(null as double) human_kappa, 'unmeasured' verdict UNION ALL SELECT 'b', date'2025-11-01', 0.5, 'no'")
    s = validity.standing(rows, "2026-02-01").first()
    assert (s.binding, s.binding_compared, s.last_human, s.days_since, s.stale, s.only_self_consistent) == (1, 0, "b", 92, True, True)


def test_as_of_takes_the_latest_version(spark):
    events = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "m", 9), (4, None, 9)], "id int, k string, at int")
    versions = spark.createDataFrame([("k", 2, "x"), ("k", 5, "y"), ("m", 10, "z")], "k string, since int, v string")
    got = matching.as_of(events, versions, "k", "at", "since").collect()
    assert sorted((r.id, r.v) for r in got) == [(1, "y"), (2, None), (3, None), (4, None)]


def test_reuse_and_only(spark):
    w = spark.createDataFrame([(1, "a", None), (2, "a", "b"), (3, "c", "d")], "run int, x string, y string")
    s = spark.createDataFrame([(1, "a", None), (2, "z", "q")], "run int, x string, y string")
    got = {r.run: (r.reused, r.first_mismatch, r.mismatches) for r in matching.reuse(w, s, "run", ["x", "y"]).collect()}
    assert got == {1: (True, None, ""), 2: (False, "x", "x,y"), 3: (False, None, None)}
    with pytest.raises(ValueError, match="nothing"):
        matching.only(w, "x", ["a", "none"])


def test_doctor_verdicts(spark):
    kinds = {
        "ok": [("reference", None, "pass", None), ("mutant", "killed", "fail", "generated")],
        "ref": [("reference", None, "fail", None), ("mutant", "killed", "fail", "generated")],
        "hand": [("reference", None, "pass", None)] + [("mutant", "killed", "fail", "generated")] * 9 + [("mutant", "killed", "pass", "hand")],
        "weak": [("reference", None, "pass", None), ("mutant", "killed", "fail", "generated"), ("mutant", "killed", "pass", "generated")],
        "none": [("mutant", "killed", "fail", "generated")],
        "open": [("reference", None, "pass", None), ("reference", None, "timeout", None), ("mutant", "killed", "fail", "generated")],
    }
    rows = [(t, *r) for t, rs in kinds.items() for r in rs]
    got = verifiers.doctor_summary(spark.createDataFrame(rows, "task string, kind string, expect string, status string, origin string"))
    assert {r.task: r.verdict for r in got.collect()} == {"ok": "healthy", "ref": "unhealthy", "hand": "unhealthy", "weak": "unhealthy", "none": "inconclusive", "open": "inconclusive"}


def test_suggestions(spark):
    rows = [("s", 0.0, 1.0, 10.0, 8.0)] * 5 + [("w", 1.0, 0.0, 10.0, 8.0)] * 2 + [("n", None, 1.0, 10.0, 8.0)]
    got = trials.suggestions(spark.createDataFrame(rows, "set string, base double, candidate double, base_s double, candidate_s double")).collect()
    d = {(r.set, r.stage, r.kind): r.decision for r in got}
    assert d["s", "A", "speed"] == "advance" and d["s", "B", "quality"] == "finalist"
    assert d["w", "A", "speed"] == "drop" and d["w", "B", "speed"] == "inconclusive" and d["w", "B", "output-fix"] == "drop"
    assert d["n", "A", "quality"] == "inconclusive"


def test_components(spark):
    paths = {"system-prompt.md": "system-prompt", "memory/a.md": "memory", "skills/x-1/SKILL.md": "skill", "memory/../a.md": "refused", "/memory/a.md": "refused", "other": "refused", "": "refused"}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", text.component(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in got} == paths


def test_journal_adds_each_key_once(spark, tmp_path):
    where = str(tmp_path / "journal")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        writers.append_journal(rows, where, ["k"])
    writers.append_journal(spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), where, ["k"])
    assert sorted(tuple(r) for r in readers.jsonl(spark, where, "k int, v string", strict=True).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_report_and_documents(spark, tmp_path):
    df = spark.sql("SELECT 'he-1' id, map('b', 2, 'a', 1) m, array('x', 'y') touches, 'Body | text' body, 'edit' kind")
    writers.write_report(df.select("id", "m"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first().value == '{"id":"he-1","m":{"a":1,"b":2}}'
    with pytest.raises(AnalysisException):
        writers.write_report(df.select("id"), str(tmp_path / "r"))
    doc = writers.document({"id": F.col("id")}, {"touches": F.col("touches")}, F.col("body"))
    writers.write_documents(df, str(tmp_path / "d"), "kind", doc)
    back = readers.frontmatter(spark, str(tmp_path / "d" / "kind=edit")).first()
    assert back.attrs["id"] == "he-1" and back.list_attrs["touches"] == ["x", "y"] and back.body.strip() == "Body | text"
    assert writers.markdown_table(df.select("id", "body")).first().line == "| he-1 | Body \\| text |"


def test_bradley_terry_is_where_wins_are_as_expected(spark):
    """At the fit, each system's expected wins equal its wins (with half a win each way on every pair, met or not)."""
    rows = [("g", "a", "b", 5, 1, 2, 1), ("g", "b", "c", 3, 2, 0, 1), ("g", "a", "d", 1, 4, 1, 1)]
    t = spark.createDataFrame(rows, "grp string, low string, high string, low_wins long, high_wins long, ties long, labelers long")
    s = {r.system: r.strength for r in pairwise.bradley_terry(t, rounds=2000).collect()}
    wins = {(x, y): 0.5 for x in "abcd" for y in "abcd" if x != y}
    for _, low, high, w, l, ties, _ in rows:
        wins[low, high] += w + ties / 2
        wins[high, low] += l + ties / 2
    for x in "abcd":
        expected = sum((wins[x, y] + wins[y, x]) * s[x] / (s[x] + s[y]) for y in "abcd" if y != x)
        assert expected == pytest.approx(sum(wins[x, y] for y in "abcd" if y != x), abs=1e-6)
    assert s["a"] * s["b"] * s["c"] * s["d"] == pytest.approx(1)


def test_promote_needs_both_splits_and_one_improvement(spark):
    for held_in, held_out, want in (("improve", "hold", True), ("hold", "improve", True), ("hold", "hold", False), ("improve", "regress", False), ("improve", None, False)):
        rows = [(s, v) for s, v in (("held-in", held_in), ("held-out", held_out)) if v]
        assert sequential.promote(spark.createDataFrame(rows, "split string, verdict string")).first().promote is want, (held_in, held_out)


def test_fixed_places_round_the_binary_value(spark):
    """Halves in decimal that lie below or above in binary; exact halves go to even."""
    numbers = [0.1125, 0.0005, 0.0015, 0.2345, 0.3335, 0.0625, 0.1875, 1.0005, 1234.5675, 0.0, -0.0025, 0.149500000001, 0.0004, 0.0009, -0.0005, -0.0001, *((1000 * k + 500) / 1e6 for k in range(600))]
    got = [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(numbers)], "k long, v double").orderBy("k").select(text.fixed(F.col("v"), 3).alias("x")).collect()]
    assert got == [f"{v:.3f}" for v in numbers]


def test_accepted_edits_on_a_propose_only_surface(spark):
    """The view of GR15 holds what the rule looks for: without it the rule passes over the whole table for nothing."""
    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_custkey % 3 = 0 and o_custkey % 5 in (1, 2)")
    edits = orders.where("o_orderkey % 6 = 0 or o_orderkey % 6 = 5 and o_custkey % 4 <> 0").select(F.concat(F.lit("n"), "o_orderkey").alias("id"))
    found = catalog.queries()["GR15_propose_only_accepted"](spark, sf)
    assert 0 < found.count() == edits.count() and found.exceptAll(edits).count() == 0
