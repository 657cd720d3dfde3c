import random

import corpus_pipeline
from tallyforge.llm import simhash, word_copies
from tests.llm.test_operators import rows

SCHEMA = "doc_id long, text string, lang string, source string"


def brute_kept(pairs, size=5, per_mille=800):
    """Rows kept, as counts of (doc_id, text), by comparing all pairs."""
    sets = []
    for _, t in pairs:
        w = (t or "").translate({i: i + 32 for i in range(65, 91)}).split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    root = list(range(len(pairs)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both * (1000 + per_mille) >= per_mille * (len(sets[a]) + len(sets[b])):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(pairs):
        least.setdefault(find(k), []).append((i is None, i or 0))
    return sorted(min(v) for v in least.values())


def planted():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for k in range(30):
        base = rng.choices(words, k=rng.randint(60, 300))
        out.append((10 * k, " ".join(base)))
        for j in range(rng.randint(0, 4)):  # from near copies to texts that are not: one word changed costs five shingles
            other = list(base)
            for _ in range(rng.randint(1, 1 + len(base) // 40)):
                other[rng.randrange(len(other))] = rng.choice(words)
            out.append((10 * k + 1 + j, " ".join(other).upper() if j == 2 else " ".join(other)))
    hot = rng.choices(words, k=200)
    for j in range(60):  # a large group; and texts that share only a passage with it
        out.append((1000 + j, " ".join([*hot, f"x{j}"])))
        out.append((2000 + j, " ".join([*rng.choices(words, k=120), *hot[:100]])))
    return [*out, (None, "a b"), (None, "a b"), (5000, "A b"), (None, "only here"), (5001, ""), (5002, None)]


def test_planted_near_copies(spark):
    pairs = planted()
    docs = spark.createDataFrame([(*p, "en", "a") for p in pairs], SCHEMA).repartition(5)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((i is None, i or 0) for i, _ in rows(kept, "doc_id", "text")) == brute_kept(pairs)
    found = len(pairs) - kept.count()  # all that brute force finds: a recall of 1
    within_two_bits = {r.doc_id for r in simhash.near_duplicates(docs).where("doc_id = component_id").collect()}
    assert len(pairs) - len(within_two_bits) < 0.9 * found  # what op10's parameters alone would find


def test_rare_links_between_frequent_texts(spark, monkeypatch):
    """Texts made of passages that many share, at every similarity around the bound, with links that no leader sees; against all pairs."""
    monkeypatch.setattr(word_copies, "HOT", 3)
    monkeypatch.setattr(word_copies, "BIG_KEY", 2)
    monkeypatch.setattr(word_copies, "BROADCAST_KEYS", 20)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passages = [rng.choices(words, k=30) for _ in range(6)]
    pairs = []
    for k in range(160):
        text = [w for p in rng.sample(passages, rng.randint(1, 5)) for w in p] + rng.choices(words, k=rng.choice((0, 3, 8, 20)))
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = rng.choice(words)
        pairs.append((k if k % 9 else None, " ".join(text)))
    pairs += [(k, None) for k in range(4)] + [(900 + k, " ".join(passages[0] * 300)) for k in range(3)] + [(950, " ".join(passages[0] * 300 + ["end"]))]
    docs = spark.createDataFrame([(i, *p, "clash", "clash") for i, p in enumerate(pairs)], "row long, doc_id long, text string, class string, name string").repartition(5)
    gone = {r.row for r in word_copies.repeats(docs).collect()}
    kept = sorted((pairs[i][0] is None, pairs[i][0] or 0) for i in range(len(pairs)) if i not in gone)
    assert kept == brute_kept(pairs) and len(pairs) - len(kept) > 10


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert word_copies.repeats(docs.selectExpr("doc_id row", "doc_id", "text")).count() == 0


def counted(monkeypatch, name):
    """The rows of every table that a function of word_copies made or, for compared, was given."""
    made, real = [], getattr(word_copies, name)

    def run(pairs, *rest):
        out = real(pairs, *rest)
        made.append((pairs if name == "compared" else out).distinct().count())
        return out

    monkeypatch.setattr(word_copies, name, run)
    return made


def test_pairs_of_a_common_passage(spark, monkeypatch):
    """Texts of which a passage is most, but mostly not enough for the similarity: their pairs are not made."""
    monkeypatch.setattr(word_copies, "HOT", 3)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    passage = rng.choices(words, k=100)
    pairs = [(k, " ".join([*passage, *rng.choices(words, k=3 + k % 17)])) for k in range(150)]
    docs = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "row long, doc_id long, text string").repartition(5)
    made = counted(monkeypatch, "apart")
    gone = {r.row for r in word_copies.repeats(docs).collect()}
    assert sorted((False, i) for i, _ in pairs if i not in gone) == brute_kept(pairs) and len(gone) > 20
    assert sum(made) < len(pairs)


def test_groups_of_fingerprints_spare_comparisons(spark, monkeypatch):
    """Rows that a verified group has joined are not compared again; without groups they are, with the same rows kept."""
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(k, k, " ".join([*words, f"x{k}"])) for k in range(12)], "row long, doc_id long, text string").repartition(3)
    groups = spark.createDataFrame([(k, 0) for k in range(1, 12)], "row long, head long")
    made = counted(monkeypatch, "compared")
    gone = [sorted(r.row for r in word_copies.repeats(docs, grouped=g).collect()) for g in (groups, None)]
    assert gone == [list(range(1, 12))] * 2
    assert made == [11, 0, 11]
