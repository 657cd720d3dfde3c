import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import canonical
from tallyforge.operators import selection, trials, verifiers


def groups():
    rng = random.Random(4)
    rows = [("hot", float(rng.choice([rng.gauss(0, 1), rng.randint(-5, 5), 10.0 ** rng.randint(-300, 300)]))) for _ in range(2000)]
    rows += [(f"g{k}", rng.random()) for k in range(12) for _ in range(rng.randint(1, 40))] + [("same", 7.0)] * 50 + [("two", -1e308), ("two", 1e308), ("tiny", 5e-324), ("tiny", 1e-323), ("tiny", 1.5e-323), ("none", None), ("one", 3.0), ("some", None), ("some", 2.0)]
    return rows


@pytest.mark.parametrize("limit", [0, 10**6])
def test_medians_of_groups_of_any_size(spark, monkeypatch, limit):
    monkeypatch.setattr(selection, "SMALL_GROUP", limit)
    rows = groups()
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    held = {}
    for g, v in rows:
        if v is not None:
            held.setdefault(g, []).append(v)
    got = {r.g: r.median for r in selection.medians(df, "g", "v").collect() if r.median is not None}
    assert set(got) == set(held) and all(got[g] == pytest.approx(statistics.median(v), rel=1e-15, abs=0) or g == "two" for g, v in held.items()) and got["two"] == 0
    upper = {r.g: r.upper_median for r in selection.upper_medians(df, "g", "v").collect() if r.upper_median is not None}
    assert upper == {g: sorted(v)[len(v) // 2] for g, v in held.items()}
    assert selection.medians(df.limit(0), "g", "v").count() == 0


def test_bands_by_mean_and_mad(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    obs = spark.createDataFrame([("x", v, 0.0, 0.0, 0.5) for v in values], "name string, value double, ci_half double, band_lo double, band_hi double")
    r = verifiers.derive_bands(obs, "name", relative=0.0, k=2.0, centre="mean", spread_by="mad").first()
    assert (r.centre, r.binding, r.half_width) == (22.0, "k*mad", pytest.approx(2 * 1.4826)) and r.lo <= 22 - 2 * 1.4826 <= r.lo + 1e-4
    assert verifiers.derive_bands(obs, "name", relative=0.0, k=2.0).first().centre == 3.0


def test_early_cut_counts_d_and_r_together(spark):
    item = "set string, stratum string, reference string, base double, candidate double, base_s double, candidate_s double"
    rows = [("D", "a", "x", 1.0, 0.0, 1.0, 1.0), ("R", "a", "x", 1.0, 0.0, 1.0, 1.0), ("D", "a", "x", 1.0, 1.0, 1.0, 1.0), ("D", "a", None, 1.0, 0.0, None, None)]
    cards = spark.createDataFrame([("A", "A", "quality", 1, 1), ("B", "B", "quality", 3, 1), ("C", "C", "quality", 1, 1)], "card string, stage string, kind string, min_evaluable int, min_per_stratum int")
    got = {r.card: r for r in trials.card_suggestions(spark.createDataFrame(rows, item), cards).collect()}
    assert (got["A"].decision, got["A"].newly_wrong, got["A"].points) == ("drop", 2, -50.0)  # one in each set: neither alone would cut
    assert (got["B"].decision, got["B"].why_not, got["B"].evaluable) == ("inconclusive", "below-floor", 2) and got["C"].why_not == "none-evaluable"


GOLDEN = [
    ('{"model":"m","seed":1}', '{"model":"m"}'), (' { "temperature" : 0.70 , "model" : "a<b>&c" } ', '{"model":"a\\u003cb\\u003e\\u0026c","temperature":0.70}'),
    ('{"extra_body":{"z" : 1e0, "a":[ 1 , 2 ]},"model":"x","model":"y"}', '{"extra_body":{"z":1e0,"a":[1,2]},"model":"y"}'), ("{}", "{}"), ("[]", None), ("{", None), (None, None), ('{"model"', None), ('{"model":1,', None),
    ('{"model":"tab\\t \\u0041 é"}', '{"model":"tab\\t \\u0041 é"}'),
]


def test_picked_settings():
    for text, want in GOLDEN:
        assert canonical.picked(text) == want, text


def test_reuse_digest(spark):
    import hashlib

    parts = {p: F.lit("") for p, _ in canonical.REUSE_PARTS} | {"task": F.lit('q"\\\n\x1f<é>'), "allow_tie": F.lit(True), "seed": F.lit(3), "judge_seed": F.lit(None).cast("int")}
    want = '{"task_sha256":"q\\"\\\\\\n\\u001f\\u003cé\\u003e","conversation_sha256":"","candidates_sha256":"","prompt_version":"","cmoa_version":"","selection_rule":"","judge_sha256":"","allow_tie":true,"seed":3,"judge_seed":0}'
    assert spark.range(1).select(canonical.reuse_digest(parts).alias("d")).first().d == hashlib.sha256(want.encode()).hexdigest()
