"""Cases in which a near reading of the rules would give another answer."""

from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import agreement, graph, mining, pairwise, sequential, validity

NODE = "id string, kind string, status string, component string, approval string, touches array<string>, in_force_from date, in_force_until date"


def test_surfaces(spark):
    rows = [(f"a-{c}", "edit", "accepted", c, "auto", [c], None, None) for c in (*graph.SURFACES, "verifier", "sub-agent")] + [("none", "edit", "accepted", "skill", "human", None, None, None)]
    rules = {k: graph.RULES[k] for k in ("edit_touches_readonly", "accepted_without_approver")}
    got = {(r.id, r.rule) for r in graph.findings(spark.createDataFrame(rows, NODE), spark.createDataFrame([], "src string, dst string, name string"), "2026-01-01", rules).collect()}
    assert {i for i, r in got if r == "edit_touches_readonly"} == {"a-verifier", "a-sub-agent", "none"}
    assert {i for i, r in got if r == "accepted_without_approver"} == {"a-system-prompt", "a-tool-description", "a-middleware", "a-subagent-config"}


def test_coverage_is_selected_over_steps(spark):
    rows = [("selected", None, 1.0, None), ("selected", "exit 1", None, None), ("no_candidate", "", 3.0, "unanimous"), ("judge_failed", None, 8.0, None)]
    runs = spark.createDataFrame([("b", o, e, w, c, "hash" if c else None, 10) for o, e, w, c in rows], "cond string, outcome string, error string, wall_seconds double, consensus string, tie_break string, latency_ms long")
    r = validity.conditions(runs, "cond").first()
    assert (r.steps, r.selected, r.no_candidate, r.unmeasured, r.errors, r.coverage, r.mean_wall_seconds, r.median_wall_seconds, r.consensus_steps) == (4, 1, 1, 2, 1, 0.25, 4.0, 3.0, 1)
    assert [tuple(x) for x in validity.tie_breaks(runs, "cond").collect()] == [("b", "consensus", "hash", 1)]


PAIRS = "split string, pair_id long, task_id string, outcome int"


def test_discordance_cuts_before_it_leaves_out(spark):
    pairs = spark.createDataFrame([("in", i, "t", None if i < 20 else 1) for i in range(30)] + [("in", 30 + i, "t", 0) for i in range(30)], PAIRS)
    r = sequential.discordance(pairs).first()
    assert (r.n, r.rate, r.warned) == (10, 1.0, True)
    assert tuple(sequential.discordance(pairs.where("outcome is null")).first()) == (0, 0.0, False)


def test_batches_are_of_scheduled_pairs(spark):
    pairs = spark.createDataFrame([("in", i, f"t{i}", None if i < 7 else 1) for i in range(25)], PAIRS)
    r = sequential.stop_at(pairs, batch=10).first()
    assert (r.stop_n, r.stop_answered, r.pairs) == (20, 13, 25)  # answered pairs alone would stop at 10 of them
    lost = spark.createDataFrame([("in", i, f"t{i // 2}", -1 if i in (4, 5) else 0) for i in range(25)], PAIRS)
    assert sequential.stop_at(lost, batch=10).first().stop_n is None
    assert sequential.stop_at(lost, sequential.Params(most_lost=0), batch=10).first().stop_n == 10
    short = spark.createDataFrame([("in", i, f"t{i}", 1) for i in range(9)], PAIRS)
    assert sequential.stop_at(short, batch=10).first().stop_n == 9  # the last batch is short


def test_error_texts_are_cut_at_bytes(spark):
    cases = {"é" * 170: "é" * 80 + " […]", "x" * 159 + " yz": "x" * 159 + " […]", "\ta\xa0\n b\r\n": "a b", "ok": "ok", "x" * 160: "x" * 160, "x" * 159 + "é": "x" * 159 + "� […]"}
    df = spark.createDataFrame(list(cases.items()), "a string, b string")
    assert [(r.a, r.t) for r in df.select("a", "b", text.tidy(F.col("a")).alias("t")).collect() if r.t != r.b] == []


def test_lists_say_how_many_more(spark):
    rows = spark.createDataFrame([("http_error", f"HTTP 50{k % 10} x{k:02d}") for k in range(11)] + [("http_error", "HTTP 429"), ("ok", None), ("http_error", None)], "status string, error string")
    r = mining.not_mined(rows).first()
    assert r.n == 12 and r.texts.endswith("; and 3 more") and r.texts.count("; ") == 8
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    names = lambda *xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    assert [one(text.named("task", names(*xs))) for xs in ((), ("a",), ("a", "b"), tuple("abcdef"))] == ["an unnamed task", "task a", "tasks a, b", "tasks a, b, c, d, and 2 more"]
    assert one(text.listed(names())) == "unknown" and one(text.span(names("3", "1", "2"))) == "1-3" and one(text.span(names("3", "x"))) == "3, x" and one(text.span(F.array(F.lit(7), F.lit(7)))) == "7"
    assert [one(text.number(F.lit(x))) for x in (0.0, 12.0, 1.25, 0.33335, -3.10)] == ["0.0", "12.0", "1.25", "0.3334", "-3.1"]


def test_pair_with_most_in_common(spark, monkeypatch):
    """Against all pairs, with an item that most raters have, blocks smaller than the raters, and repeated labels."""
    import random
    from collections import Counter
    from itertools import combinations

    rng = random.Random(3)
    rows = [(f"r{r:02d}", i, rng.choice("ab"), k) for k, (r, i) in enumerate((r, i) for r in range(40) for i in range(60) if i == 0 or rng.random() < 0.1 + r % 5 / 20 for _ in range(rng.choice((1, 1, 2))))]
    held = {}
    for rater, item, _, _ in rows:
        held.setdefault(item, set()).add(rater)
    shared = Counter(p for raters in held.values() for p in combinations(sorted(raters), 2))
    best = min(shared, key=lambda p: (-shared[p], p))
    labels = spark.createDataFrame(rows, "rater string, item long, choice string, seq long").repartition(4)
    for limit in (20_000, 0):
        monkeypatch.setattr(agreement, "BROADCAST_ITEMS", limit)
        got = agreement.most_shared_pair(agreement.first_labels(labels, "rater", "item", "choice", "seq"), block=8).collect()
        assert [tuple(r) for r in got] == [(*best, shared[best])]
    r = agreement.human_agreement(labels, "rater", "item", "choice", "seq", ["a", "b"]).first()
    first = {}
    for rater, item, choice, _ in rows:
        first.setdefault((rater, item), choice)
    same = [first[best[0], i] == first[best[1], i] for i in held if set(best) <= held[i]]
    assert (r.n, r.p_o) == (len(same), sum(same) / len(same))
    assert agreement.human_agreement(labels.where("rater = 'r01'"), "rater", "item", "choice", "seq", ["a", "b"]).count() == 0


def test_samples_by_strata(spark):
    df = spark.createDataFrame([("a" if i < 50 else "b" if i < 53 else "c", i) for i in range(100)], "s string, k long")
    sizes = lambda target: {r.s: r.n for r in pairwise.stratified_sample(df, "s", "k", {"a": 0.5, "b": 0.25, "c": 0.25}, target).groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert sizes(20) == {"a": 10, "b": 3, "c": 7} and sizes(0) == sizes(100) == {"a": 50, "b": 3, "c": 47}  # the last stratum takes what the second lacks


def test_binding_periods(spark):
    rows = [("old", "clause", "accepted", "2026-01-01", None), ("mid", "clause", "accepted", "2026-02-01", "2026-03-01"), ("new", "clause", "accepted", "2026-02-10", "2026-02-20"), ("draft", "clause", "proposed", "2026-01-05", None)]
    nodes = spark.createDataFrame(rows, "id string, kind string, status string, a string, b string").selectExpr("id", "kind", "status", "'MAY' modality", "date(a) in_force_from", "date(b) in_force_until", "'x' split", "'x' verdict")
    edges = spark.createDataFrame([("mid", "old", "supersedes"), ("new", "old", "supersedes"), ("draft", "mid", "supersedes")], "src string, dst string, name string")
    periods = graph.binding_periods(nodes, edges)
    got = sorted((r.id, str(r.since), str(r.until)) for r in periods.collect())
    assert got == [("mid", "2026-02-01", "2026-03-01"), ("new", "2026-02-10", "2026-02-20"), ("old", "2026-01-01", "2026-02-01"), ("old", "2026-03-01", graph.FOREVER)]
    days = spark.sql("SELECT explode(sequence(date'2025-12-30', date'2026-04-01')) day")
    each = {(r.id, str(r.day)) for r in graph.on_days(periods, days, width=7).collect()}
    assert ("old", "2026-01-31") in each and ("old", "2026-02-01") not in each and ("old", "2026-03-01") in each and ("old", "2025-12-31") not in each
    for day in ("2026-01-15", "2026-02-15", "2026-03-15"):
        at = {r.id for r in graph.projections(nodes, edges, day, {"effective": graph.PROJECTIONS["effective"]}).where("effective").collect()}
        assert at == {i for i, d in each if d == day}


def test_pair_with_most_in_common_by_hot_items(spark, monkeypatch):
    """Items that most raters have are bits of masks, not pairs; against all pairs, with ties, and where pairs share such items alone."""
    import random
    from collections import Counter
    from itertools import combinations

    monkeypatch.setattr(agreement, "HOT_ITEM", 10)
    monkeypatch.setattr(agreement, "PAIRS_A_TASK", 50)
    for seed, masked, density in ((1, 2, 0.15), (2, 12, 0.02), (3, 1, 0.0), (4, 3, 0.4)):
        monkeypatch.setattr(agreement, "MASKED", masked)
        rng = random.Random(seed)
        rows = sorted({(f"r{rng.randrange(60):02d}", i) for i in range(5) for _ in range(40)} | {(f"r{r:02d}", 10 + i) for r in range(60) for i in range(40) if rng.random() < density})
        held = {}
        for rater, item in rows:
            held.setdefault(item, set()).add(rater)
        shared = Counter(p for raters in held.values() for p in combinations(sorted(raters), 2))
        best = min(shared, key=lambda p: (-shared[p], p))
        got = agreement.most_shared_pair(spark.createDataFrame(rows, "rater string, item long"), block=1).collect()
        assert [tuple(r) for r in got] == [(*best, shared[best])]


def test_clusters_of_a_group_stay_apart(spark):
    """The groups' totals go to the clusters: a group's clusters never meet in one task to be sorted."""
    rows = [(g, c, "ab"[c % 2], "ab"[c % 3 % 2]) for g in "xy" for c in range(20)]
    df = spark.createDataFrame(rows, "g string, c long, first string, second string")
    df = df.unionByName(df.where("c < 0"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = agreement.agreement_by(df, ["g"], "first", "second", "c", ["a", "b"])
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and {(r.g, r.n, r.clusters) for r in found.collect()} == {("x", 20, 20), ("y", 20, 20)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
