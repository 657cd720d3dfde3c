"""op11, op12 and op13 against brute force in plain Python."""

import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import catalog, merkle, secret_scan, vector_codes
from tallyforge.llm.catalog import tokenizer
from tallyforge.llm.shared import shared_dir
from tests.compare import assert_same, duck

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# op11


def brute_base(text):
    """The known shapes by scanning for each on its own."""
    found = []
    key = r"[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    for kind, pattern, group, least in (("assign", rf"(?:{key})[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)):
        at = 0
        while m := re.compile(pattern).search(text, at):
            if len(m[group]) >= least:
                found.append((kind, m.start(), m.end()))
            at = m.end()
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def brute_random(text, base, coder):
    """Strings that meet no base span, counted by another library with the same vocabulary."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        s = m[0].strip("=-_/+")
        if m[0].startswith("sha256-") and len(m[0]) == 51 and m[0].endswith("="):
            continue  # an integrity value
        known = re.fullmatch("[0-9A-Fa-f]+", s) and len(s) in (32, 40, 56, 64, 96, 128) or re.fullmatch("[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", s) or re.fullmatch("[0-9+/_=TZ-]*", s)
        if len(s) < 20 or len(set(s)) < 8 or known or any(a < m.end() and m.start() < b for _, a, b in base):
            continue
        if len(s) <= 2 * len(coder.encode(s, add_special_tokens=False).ids):
            start = m.start() + len(m[0]) - len(m[0].lstrip("=-_/+"))
            out.append(("random", start, start + len(s)))
    return out


def secrets():
    rng = random.Random(3)
    letters = string.ascii_letters + string.digits + "+/"
    make = lambda n, alphabet=letters: "".join(rng.choice(alphabet) for _ in range(n))
    hexes = lambda n: make(n, "0123456789abcdef")
    texts = [
        None, "", "pässword = short", f'é token : "{hexes(40)}" and {hexes(31)} {hexes(32)}', f"token=secret = {make(20)}", "api_key=password=abcdefghij", f"PASSWD:'{make(9)}' ſecret=abcdefghijkl",
        "AKIA" + "AKIA" * 3, "AKIAAKIA1234567", "xAKIA" + make(12, string.ascii_uppercase), f"sha256-{make(43)}= {hexes(64).upper()} 123e4567-e89b-12d3-a456-426614174000",
        "2024-01-01T00-00-00 " + "1234567890" * 4, "a" * 500, "internationalization_of_things getElementsByTagNameNS", "Rindfleischetikettierungsueberwachungsaufgabe", f"==={make(40)}===", make(5000),
        (make(30) + " word " * 50) * 200, "secret:" + "x" * 100_000,
    ]
    return texts + [f"see {make(rng.randint(15, 70))} and {make(rng.randint(20, 40), string.ascii_lowercase)}, {hexes(rng.randint(28, 50))}" for _ in range(60)]


def test_secret_scan(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    texts = secrets()
    docs = spark.createDataFrame([(None if i == 5 else i % 70, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id int, text string, spans string, start string").repartition(3)
    found = secret_scan.secret_scan(docs, tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("text",))
    whole = {r.text: r for r in found.withColumn("clean", secret_scan.redacted(F.col("text"), F.col("spans"))).collect()}
    got = sorted(tuple(r) for r in secret_scan.digests(found).na.fill(-1, ["doc_id"]).collect())
    want = []
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        added = brute_random(t or "", base, coder)
        line = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        every = sorted([*base, *added], key=lambda s: (s[1], ["assign", "access", "hex", "random"].index(s[0])))
        number = lambda kind: sum(k == kind for k, _, _ in every)
        want.append((-1 if i == 5 else i % 70, number("assign"), number("access"), number("hex"), sha(line(base)), line(every), number("random")))
        if t is not None:  # the text without its spans
            covered = {p for _, a, b in every for p in range(a, b)}
            assert whole[t].clean.replace("[secret]", "") == "".join(c for p, c in enumerate(t) if p not in covered)
    assert got == sorted(want)
    assert sum(w[6] for w in want) > 60 and secret_scan.digests(found.limit(0)).count() == 0


def test_random_strings_are_told_from_words(spark):
    """At least 0.95 of random strings are found; none of the words of four languages, joined to long ones, is."""
    import public_tokenizers

    coder, rng = secret_scan.encoding(tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), random.Random(1)
    strings = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(20, 60))) for _ in range(400)]
    assert sum(bool(secret_scan.spans(s, coder)) for s in strings) >= 0.95 * len(strings)
    words = "internationalization characteristics responsibilities anticonstitutionnellement Geschwindigkeitsbegrenzung Krankenversicherungskarte desafortunadamente electrodomesticos developpement environnement".split()
    assert not any(secret_scan.spans(a + sep + b, coder) for a in words for b in words for sep in ("_", "/", "-"))


# op12


def brute_manifest(rows, fanout=16):
    """doc_id, leaf, subroot, root, proof, folded root and whether it is the root."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else t.translate({i: i + 32 for i in range(65, 91)})
    one = lambda r, text: sha("".join(map(field, (r[0], r[1], r[2], r[3], text))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
        return out

    def siblings(tree, i):
        for level in tree[:-1]:
            run = i // fanout * fanout
            yield level[run:i], level[i + 1 : run + fanout]
            i //= fanout

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, one(r, r[4]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(groups[s], key=lambda x: x[:3]), levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])])) for s in order}
    crown = levels([trees[s][1][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(trees[s][0]):
            path = [*siblings(trees[s][1], i), *siblings(crown, place)]
            now = one(r, lower(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf
            for before, after in path:
                now = sha("".join([*before, now, *after]))
            out.append((r[0], leaf, trees[s][1][-1][0], crown[-1][0], sha("".join(x for b, a in path for x in [*b, *a])), now, now == crown[-1][0]))
    return out


def manifest_rows():
    rows = [(i, "hot", "en", i % 7, f"Text {i}") for i in range(300)] + [(i, None, None, None, None) for i in range(18)] + [(None, "hot", "de", 1, ""), (None, None, "de", 2, "é")]
    rows += [(5, "hot", "en", 5, "Other text"), (7, "hot", "en", 0, "Text 7"), (7, "hot", "en", 0, "Text 7"), (1, "lone", "en", 4, "LONE"), (2, "é", "fr", 9, "Ü" * 40_000), (3, "", "fr", 0, "")]
    return rows + [(10_000, f"s{k}", "en", 1, "same text") for k in range(40)]


def test_manifest(spark):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], DOCS + ", grp int, idx int").repartition(4)
    got = merkle.manifest(docs, merkle.fifth_of_ids())
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_manifest(rows), key=key)
    states = {(r.doc_id, r.verified) for r in got.collect() if r.doc_id is not None}
    assert {True, False} == {v for _, v in states}


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257])
def test_manifest_sizes(spark, n):
    rows = [(i, "a", "en", 1, f"T{i}") for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), merkle.fifth_of_ids())
    assert sorted(map(tuple, got.collect())) == sorted(brute_manifest(rows))


# op13


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = sorted(((r[0], r[2], [math.floor(4096 * x) for x in r[1]]) for r in kept), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return []
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min((distance(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = [nearest(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                members = [c[p] for c, m in zip(cut, mine, strict=True) if m == e]
                if members:
                    books[p][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    digest = sha(",".join(str(x) for book in books for e in book for x in e))
    out = [(r[0], r[1], [nearest(c[p], books[p]) for p in range(parts)]) for r, c in zip(kept, cut, strict=True)]
    total = {}
    for _, label, found in out:
        total[label] = total.get(label, 0) + sum(d for d, _ in found)
    return [(i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), total[label], digest) for i, label, found in out]


VECTORS = "vec_id long, embedding array<float>, label int, v string, code string"


def vectors(n, dims=16, spread=1.0, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, spread, (n, dims)).astype(np.float32)
    return [(i * 3 % n if n else 0, [float(c) for c in row], None if i % 11 == 0 else i % 4) for i, row in enumerate(x)]


def key(r):
    return tuple((x is not None, x) for x in r)


def test_vector_codes(spark):
    rows = vectors(300)
    rows += [(None, rows[0][1], 1), (4, rows[1][1], 1), (4, rows[1][1], 1), (900, None, 1), (901, [1.0, None, *[0.5] * 14], 1), (902, [float("nan")] * 16, 1), (903, [float("-inf"), *[0.5] * 15], None), (904, [], 1)]
    rows += [(1000 + i, [0.25] * 16, 2) for i in range(80)]  # a hot vector, all ties
    got = vector_codes.vector_codes(spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS).repartition(5))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_codes([r for r in rows if r[1] != []]), key=key)


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17])
def test_few_vectors(spark, n):
    got = vector_codes.vector_codes(spark.createDataFrame([(*r, "", "") for r in vectors(n)], VECTORS))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_codes(vectors(n)), key=key)


def test_lengths_that_cannot_be_cut(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [0.5] * 9, 1, "", "")], VECTORS))
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [3e9] * 8, 1, "", "")], VECTORS))


@pytest.mark.parametrize("spread", [1, 40, 10**6])
def test_trees_find_the_nearest_entry(spread):
    """Against all entries, with many ties where the spread is small."""
    rng = np.random.default_rng(spread)
    for n in (1, 2, 3, 16, 50):
        book, x = rng.integers(-spread, spread + 1, (n, 4)), rng.integers(-spread, spread + 1, (500, 4))
        index, best = vector_codes.nearest(x, book, vector_codes.tree(book))
        every = vector_codes.squared(x[:, None], book[None])
        assert (best == every.min(1)).all() and (index == every.argmin(1)).all()


def test_decoded_vectors_are_near(spark):
    rows = spark.createDataFrame([(*r, "", "") for r in vectors(200, spread=0.2)], VECTORS)
    whole = vector_codes.integers(rows, shared_dir(spark))
    books = vector_codes.fit(whole)
    codes = {r.vec_id: r for r in vector_codes.encode(whole, books).collect()}
    for vec_id, x, _ in vectors(200, spread=0.2):
        error = np.square(vector_codes.decode(codes[vec_id].code, books) - np.array(x)).sum() * 4096**2
        assert abs(error - codes[vec_id].error) < 0.05 * codes[vec_id].error + 3 * 16 * 4096  # floors move each component by less than one step


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_vector_codes"])
def test_matches_duckdb(spark, name):
    assert_same(catalog.queries()[name](spark, SF), duck(SF), catalog.oracle_sql()[name])
