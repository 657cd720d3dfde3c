"""Published values: evidence, sequences, agreement and intervals."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import stats, text
from tallyforge.operators import agreement, graph, pairwise, sequential
from tallyforge.streaming.gate import gate_stream, log_e


def column(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(("b", "c", "want"), [(0, 0, 0), (1, 0, 0), (5, 0, 1.6739764336), (8, 1, 1.7385149547), (12, 3, 1.5043215672), (20, 5, 3.1900859565), (0, 8, 3.3479528671), (3, 3, -0.7827593392), (15, 15, -1.4992653688)])
def test_log_e(spark, b, c, want):
    assert column(spark, stats.log_e(F.lit(b), F.lit(c))) == pytest.approx(want, abs=1e-9)
    assert log_e(b, c) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("b", "c", "lo", "hi"), [(3, 3, 0.077, 0.923), (6, 6, 0.149, 0.851), (15, 15, 0.246, 0.754), (30, 30, 0.307, 0.693), (60, 60, 0.356, 0.644), (4, 5, 0.089, 0.850), (22, 23, 0.274, 0.707), (8, 7, 0.197, 0.849), (5, 1, 0.278, 0.999), (9, 3, 0.340, 0.972), (0, 0, 0, 1)])
def test_theta_cs(spark, b, c, lo, hi):
    got = column(spark, stats.theta_cs(F.lit(b), F.lit(c)))
    assert (got.lo, got.hi) == (pytest.approx(lo, abs=6e-4), pytest.approx(hi, abs=6e-4))


@pytest.mark.parametrize(("b", "c", "pairs", "half"), [(3, 3, 30, 0.431), (6, 6, 60, 0.300), (15, 15, 150, 0.178), (30, 30, 300, 0.120), (60, 60, 600, 0.081), (15, 15, 60, 0.381)])
def test_delta_cs(spark, b, c, pairs, half):
    got = column(spark, stats.delta_cs(F.lit(b), F.lit(c), F.lit(pairs)))
    assert (got.lo, got.hi) == (pytest.approx(-half, abs=6e-4), pytest.approx(half, abs=6e-4))


def test_wilson(spark):
    for s, n, lo, hi in ((0, 20, 0, 0.16112515805281938), (15, 20, 0.531299122381256, 0.8881382985923343), (0, 0, 0, 1)):
        got = column(spark, stats.wilson(F.lit(s), F.lit(n)))
        assert (got.lo, got.hi) == (pytest.approx(lo, abs=1e-9), pytest.approx(hi, abs=1e-9))


def test_bernstein(spark):
    got = column(spark, stats.empirical_bernstein(F.lit(100), F.lit(0.5), F.lit(0.010101010101010102), 0.0, 1.0))
    assert (got.lo, got.hi) == (pytest.approx(0.36696662701416695, abs=1e-9), pytest.approx(0.633033372985833, abs=1e-9))


def rated(spark, table):
    names = "abc"
    rows = [(f"g{k % 4}", names[i], names[j]) for i, r in enumerate(table) for j, n in enumerate(r) for k in range(n)]
    return agreement.agreement(spark.createDataFrame(rows, "g string, x string, y string"), "x", "y", "g", list(names[: len(table)])).first()


def test_kappa(spark):
    a = rated(spark, [[88, 14, 18], [10, 40, 10], [2, 6, 12]])
    assert (a.p_o, a.p_e, a.kappa, a.pabak) == (pytest.approx(0.70), pytest.approx(0.41), pytest.approx(0.29 / 0.59), pytest.approx(0.55))
    b = rated(spark, [[20, 5], [10, 15]])
    assert (b.kappa, b.pabak) == (pytest.approx(0.4), pytest.approx(0.4))
    c, d = rated(spark, [[45, 5], [5, 45]]), rated(spark, [[90, 5], [5, 0]])
    assert c.p_o == d.p_o and c.kappa > 0.7 and d.kappa < 0.1
    assert rated(spark, [[30, 0], [0, 0]]).kappa is None


def derived(spark, votes):
    rows = [("g", a, b, w, "l") for a, b, w in votes]
    t = pairwise.tallies(spark.createDataFrame(rows, "grp string, first string, second string, winner string, labeler string"))
    return pairwise.triples(t).first()


def test_triples(spark):
    assert derived(spark, [("a", "b", "first"), ("b", "c", "first"), ("a", "c", "first")]).gold == "a"
    assert derived(spark, [("a", "b", "first"), ("b", "c", "first"), ("c", "a", "first")]).state == "cyclic"
    assert derived(spark, [("a", "b", "first"), ("b", "c", "first")]).state == "incomplete"
    assert derived(spark, [("a", "b", "tie"), ("b", "c", "tie"), ("a", "c", "tie")]).gold == "tie"
    assert derived(spark, [("a", "b", "first"), ("b", "c", "tie"), ("a", "c", "tie")]).gold == "tie"


def test_verdicts(spark):
    p = sequential.Params()
    for b, c, ties, want in ((0, 0, 0, "inconclusive"), (0, 0, 60, "hold"), (14, 1, 45, "improve"), (1, 14, 45, "regress"), (0, 6, 54, "inconclusive")):
        assert column(spark, sequential.verdict(F.lit(b), F.lit(c), F.lit(ties), F.lit(0), p)) == want, (b, c, ties)


def test_graph_absent_attribute(spark):
    nodes = spark.sql("SELECT 'e1' id, 'edit' kind, 'proposed' status, NULL::string modality, date'2026-01-01' in_force_from, NULL::date in_force_until, NULL::array<string> touches, NULL::string component, NULL::string approval, NULL::string split, NULL::string verdict")
    edges = spark.createDataFrame([], "src string, dst string, name string")
    assert graph.findings(nodes, edges, "2026-02-01", {"r": graph.RULES["edit_touches_readonly"]}).count() == 1
    loop = spark.createDataFrame([("a", "b", "supersedes"), ("b", "a", "supersedes"), ("b", "c", "supersedes")], "src string, dst string, name string")
    assert sorted(r.id for r in graph.cycles(loop, ["supersedes"]).collect()) == ["a", "b"]
    links = [("a", "b"), ("b", "a"), ("b", "m"), ("m", "c"), ("c", "d"), ("d", "c"), ("x", "x"), ("y", "a"), ("d", "z")]  # m and the tails are on no cycle
    got = graph.cycles(spark.createDataFrame([(*e, "excepts") for e in links] + [("m", "b", "supersedes")], "src string, dst string, name string"), ["supersedes", "excepts"])
    assert sorted((r.name, r.component, r.id, r.size) for r in got.collect()) == [("excepts", "a", "a", 2), ("excepts", "a", "b", 2), ("excepts", "c", "c", 2), ("excepts", "c", "d", 2), ("excepts", "x", "x", 1)]
    assert graph.cycles(loop, ["about"]).count() == 0


def test_text(spark):
    assert column(spark, text.slugify(F.lit(" Hello, World! "))) == "hello-world"
    assert column(spark, text.http_reason(F.lit("HTTP 429 Too Many"))) == "rate-limited" and column(spark, text.http_reason(F.lit("HTTP 503"))) is None
    assert column(spark, text.listed(F.array(*map(F.lit, "abcdef")))) == "a, b, c, d, and 2 more"
    assert column(spark, text.run_id_parts(F.lit("run/he-0001@2026-01-02-m-x-in-3"))).seq == 3
