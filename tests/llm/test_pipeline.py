import corpus_pipeline
from tallyforge.llm import decontaminate, simhash
from tests.llm.test_operators import brute_contamination
from tests.llm.test_word_copies import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == len(stages) == 5
    told = stages["language_id"](spark, docs, SF)
    assert told.columns == docs.columns and told.count() >= 0.95 * docs.count()
    kept = stages["simhash_near_dedup"](spark, told, SF)
    pairs = [tuple(r) for r in told.select("doc_id", "text").collect()]
    assert sorted((i is None, i) for i, in kept.select("doc_id").collect()) == brute_kept(pairs)
    clean = stages["decontaminate"](spark, kept, SF)
    judged = brute_contamination([tuple(r) for r in kept.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in judged if not r[5])
    mixed = stages["mix"](spark, clean, SF)
    assert mixed.columns == docs.columns and 0 < mixed.count() < clean.count()
    last = stages["shard"](spark, mixed, SF)
    assert last.count() == mixed.count()
    assert simhash.TAU == 2 and decontaminate.WINDOW == 13
