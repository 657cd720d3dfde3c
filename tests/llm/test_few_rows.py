"""Few rows take few jobs, so that the driver has little to plan and to keep."""

from pyspark.sql import functions as F

from tallyforge.llm import mixing, simhash
from tallyforge.llm.shared import stash


def n_jobs(spark):
    return spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()


def test_rounds_of_components(spark, tmp_path):
    groups = [range(0, 40), range(100, 103), range(200, 202)]
    links = [(a, a + 1) for g in groups for a in g[:-1]]
    pairs = spark.createDataFrame([*links, *((b, a) for a, b in links)], "a long, b long").repartition(3)
    before = n_jobs(spark)
    found = simhash.components(pairs, str(tmp_path))
    jobs, rounds = n_jobs(spark) - before, len(list(tmp_path.glob("edges-*")))
    assert sorted(map(tuple, found.collect())) == [(x, g[0]) for g in groups for x in g]
    assert jobs <= 4 + 2 * rounds
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_rounds_of_raking(spark, tmp_path):
    rows = [(f"s{i % 7}", f"l{i % 5}", f"t{i % 3}", 10 + 37 * i % 101) for i in range(105)]
    cells = stash(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").repartition(3), f"{tmp_path}/cells")
    before = n_jobs(spark)
    raked = mixing.rake(cells, f"{tmp_path}/rake")
    jobs, rakes = n_jobs(spark) - before, len(list((tmp_path / "rake").glob("raked-*")))
    assert jobs <= 25 + 2 * rakes
    for d in mixing.DIMS:
        got = raked.groupBy(d).agg(F.sum("weight").alias("w"), F.sum("tokens").alias("n")).collect()
        asked = {r[d]: r.n ** mixing.TEMPER[d] for r in got}
        assert all(abs(r.w - asked[r[d]] / sum(asked.values())) < 1e-9 for r in got)
