import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and repeated rows, ties, a long text, and columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    base = "The quick brown fox jumps over the lazy dog and runs far away from the old stone house by the river. "
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (None, base + "x", "en", None), (4, "", "de", "b"),
        (5, "one", "de", "b"), (6, base + base.upper(), None, "b"), (7, "é ü  ß\n\n a\tb", "fr", "c"), (8, base * 3000, "en", "c"), (9, "|" * 200, "en", "c"),
        (10, "Licensed under the Apache License, Version 2.0.", "en", "a"), (11, base.replace("fox", "cat"), "en", "a"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("batch", "fp", "row", "shard", "words", "score", "rank", "topic", "rate", "bucket", "key", "n")})
