import pytest
from pyspark.sql import functions as F

from tallyforge.operators import sequential
from tallyforge.streaming import gate

ARMS = "split string, pair_id long, arm string, passed boolean, error_class string, task_id string, task_repeats int, at int"


def arms():
    """Arms of 3 splits: one improves, one loses tasks, one stays open; arms of a pair come in different files."""
    rows = []
    for i in range(40):
        rows += [("s", i, "base", i % 7 == 0, "none", f"t{i // 4}", 4), ("s", i, "edit", i % 7 != 0, "timeout" if i == 3 else "none", f"t{i // 4}", 4)]
    for i in range(24):
        rows += [("t", i, "base", True, "none", f"t{i // 4}", 4), ("t", i, "edit", i // 4 not in (1, 3), "none", f"t{i // 4}", 4)]
        rows += [("u", i, "base", i % 2 == 0, "none", f"t{i // 4}", 4), ("u", i, "edit", i % 2 == 0, "none", f"t{i // 4}", 4)]
    return [(*r, (k * 7 + (r[2] == "edit") * 3) % 5) for k, r in enumerate(rows)] + [("u", 99, "base", True, "none", "t9", 1, 0), ("u", 1, "other", True, "none", "t0", 4, 1), ("u", 2, "base", True, "none", "t0", 4, 4)]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(gate.PROVIDER[0], None)
    spark.conf.set(*gate.PROVIDER)
    yield spark
    spark.conf.set(gate.PROVIDER[0], before) if before else spark.conf.unset(gate.PROVIDER[0])


def run(spark, where, name, p, files=1):
    """Reads what is there, a file a trigger, into a table and stops."""
    stream = gate.gate_stream(spark.readStream.schema(ARMS).option("maxFilesPerTrigger", files).json(f"{where}/in"), p)
    q = stream.writeStream.format("parquet").option("path", f"{where}/{name}").option("checkpointLocation", f"{where}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.read.schema(gate.OUT).parquet(f"{where}/{name}")


def batch(spark, rows, p):
    """Where the batch operator stops each split."""
    trials = spark.createDataFrame([r for r in rows if r[2] != "other" and r[:3] != ("u", 2, "base") or r[-1] != 4], ARMS).withColumnRenamed("passed", "pass")
    return {r.split: r.stop_n for r in sequential.stop_at(sequential.pair_outcomes(trials).where("not anomaly"), p, batch=1).collect()}


def test_killed_and_resumed_stream_equals_the_batch(rocks, tmp_path):
    rows, p = sorted(arms(), key=lambda r: r[1]), sequential.Params(most_lost=1)
    part = lambda which: rocks.createDataFrame([r for r in rows if (r[1] >= 12) == which], ARMS).repartition(1)
    part(False).write.json(f"{tmp_path}/in", mode="append")
    first = run(rocks, tmp_path, "out", p)
    before = first.count()
    part(True).write.json(f"{tmp_path}/in", mode="append")  # another stream goes on from the checkpoint
    whole = run(rocks, tmp_path, "out", p)
    assert 0 < before < whole.count()
    decided = {r.split: r for r in whole.where("decided <> ''").collect()}
    assert {s: r.decided for s, r in decided.items()} == {"s": "improve", "t": "regress"} and decided["t"].lost_tasks == 2
    stops = batch(rocks, rows, p)
    seen = {r.split: r.n for r in whole.where("kind <> 'anomaly'").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert stops["u"] is None and {s: seen[s] for s in decided} == {s: stops[s] for s in decided}
    assert whole.where("kind = 'anomaly'").count() == 2 and whole.where("kind = 'pending'").count() == 1
    assert [tuple(r) for r in gate.half_pairs(rocks, f"{tmp_path}/cp").collect()] == [("u", 99, "base")]
    rocks.createDataFrame([("u", 50, "base", True, "none", "t9", 1, 0)], ARMS).write.json(f"{tmp_path}/in", mode="append")
    with pytest.raises(Exception, match="not resumed|begun with other settings"):  # other settings
        run(rocks, tmp_path, "out", sequential.Params(most_lost=2))


def test_arms_over_many_triggers(rocks, tmp_path):
    rows = [r for r in arms() if r[0] == "s"]
    for k in range(5):
        rocks.createDataFrame([r for r in rows if r[-1] == k], ARMS).repartition(1).write.json(f"{tmp_path}/in", mode="append")
    got = run(rocks, tmp_path, "out", sequential.Params(alpha=1e-9))
    assert got.where("kind = 'reading'").count() == 39 and got.where("kind = 'pending'").count() == 1
    last = got.agg(F.max("cum_b"), F.max("cum_c"), F.max("cum_ties")).first()
    want = sequential.evidence(sequential.pair_outcomes(rocks.createDataFrame(rows, ARMS).withColumnRenamed("passed", "pass")), ["split"]).first()
    assert tuple(last) == (want.b, want.c, want.ties)
