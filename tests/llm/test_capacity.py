import pytest
from pyspark.sql import functions as F

from tallyforge.llm import mixing


@pytest.fixture(scope="module")
def sized_docs(spark):
    sizes = {"a": 90, "b": 8, "c": 2}  # the tempered targets of small categories pass what half of their tokens give
    rows = [(100 * i + j, f"{s} {lang} {t}" + " word" * 100, lang, s) for i, (s, lang, t) in enumerate((s, x, t) for s in sizes for x in ("en", "de") for t in ("prose", "!! "))
            for j in range(sizes[s] * (3 if lang == "en" else 1))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_marginals_drawn_are_the_targets(sized_docs):
    drawn = mixing.mix(sized_docs)
    assert drawn.where("copies < floor(p) or copies > floor(p) + 1 or kept <> (copies > 0)").count() == 0 and drawn.where("copies > 1").count() > 0
    got = mixing.marginals(drawn)
    assert got.where("abs(target - expected) > 0.0005").count() == 0 and got.where("abs(target - reached) > 0.08").count() == 0 and got.count() == 7
    drawn_share = drawn.agg(F.sum(F.col("p") * F.col("n_tokens")) / F.sum("n_tokens")).first()[0]
    assert abs(drawn_share - mixing.SHARE) < 0.0005


def test_marginals_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert mixing.marginals(mixing.mix(docs)).where("abs(target - expected) > 0.0005").count() == 0


def test_given_targets(spark, sized_docs):
    by_lang = spark.createDataFrame([("de", 3.0), ("en", 1.0), ("xx", 9.0)], "category string, asked double")
    asked = {"source": {"a": 0.2, "b": 0.8}, "lang": by_lang}
    drawn = mixing.mix(sized_docs, targets=asked)
    got = {(r.dimension, r.category): r for r in mixing.marginals(drawn, targets=asked).collect()}
    want = {("source", "a"): 0.2, ("source", "b"): 0.8, ("source", "c"): 0.0, ("lang", "de"): 0.75, ("lang", "en"): 0.25}
    assert all(abs(got[k].target - v) < 1e-9 and abs(got[k].expected - v) < 0.0005 for k, v in want.items()) and ("lang", "xx") not in got
    assert drawn.where("source = 'c' and copies > 0").count() == 0
