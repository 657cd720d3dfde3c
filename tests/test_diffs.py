import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.operators import diffs


def brute_steps(a, b):
    """The whole table of lengths, walked from its start."""
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out, i, j = [*out, (" ", a[i])], i + 1, j + 1
        elif j == m or (i < n and t[i + 1][j] >= t[i][j + 1]):
            out, i = [*out, ("-", a[i])], i + 1
        else:
            out, j = [*out, ("+", b[j])], j + 1
    return out, t[0][0]


texts = st.lists(st.sampled_from("abcd"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(texts, texts)
def test_script_keeps_a_longest_common_subsequence(a, b):
    steps, length = brute_steps(a, b)
    assert [*diffs.script(a, b)] == steps and sum(k == " " for k, _ in steps) == length


@settings(max_examples=150, deadline=None)
@given(texts, texts, st.integers(0, 3))
def test_diffs_can_be_read_and_applied(a, b, context):
    a, b = (["x" + line for line in side] for side in (a, b))
    text = "--- a/f.md\n+++ b/f.md\n" + "\n".join(diffs.diff_lines("".join(x + "\n" for x in a), "".join(x + "\n" for x in b), context))
    (found,) = diffs.read_diff(text)
    if context == 3:  # with fewer lines around it a hunk may fit elsewhere
        assert diffs.applied("".join(x + "\n" for x in a), found["hunks"]) == "".join(x + "\n" for x in b)
    assert sum(x[0] == "+" for h in found["hunks"] for x in h["lines"]) == sum(k == "+" for k, _ in diffs.script(a, b))


def test_hunks_as_written():
    before, after = "\n".join("abcdefghijklmnop") + "\n", "\n".join("abXdefghijklmnpq")
    assert diffs.diff_lines(before, after) == [
        "@@ -1,6 +1,6 @@", " a", " b", "-c", "+X", " d", " e", " f", "@@ -12,5 +12,5 @@", " l", " m", " n", "-o", " p", "+q",
    ]
    assert diffs.diff_lines("a\n", "a") == [] and diffs.diff_lines(None, "") == [] and diffs.diff_lines(None, "a") == ["@@ -1,0 +1,1 @@", "+a"]


def test_long_texts_need_little_memory():
    rng = random.Random(2)
    a = [rng.choice("abcdefgh") for _ in range(3000)]
    b = [x for x in a if rng.random() > 0.1]
    steps = [*diffs.script(a, b)]
    assert [x for k, x in steps if k != "+"] == a and [x for k, x in steps if k != "-"] == b and sum(k == " " for k, _ in steps) == len(b)


HEAD = "diff --git a/{0} b/{0}\n"
CASES = [
    ("error", "", None, "not-ok", "error"), ("ok", "", None, "not-ok", "ok"), ("ok", "no diff here", None, "not-applicable", None),
    ("ok", "--- a/memory/a.md\n+++ b/memory/a.md\n@@ -1,3 +1,2 @@\n one\n-two\n", None, "not-applicable", None),  # the hunk is cut short
    ("ok", "--- a/memory/a.md\n+++ b/memory/a.md\n@@ -1 +1 @@\n-other\n+x\n", None, "not-applicable", None),
    ("ok", "--- a/memory/none.md\n+++ b/memory/none.md\n@@ -1 +1 @@\n-one\n+x\n", None, "not-applicable", None),
    ("ok", "--- /dev/null\n+++ b/memory/a.md\n@@ -0,0 +1 @@\n+x\n", None, "not-applicable", None),  # it is there already
    ("ok", HEAD.format("memory/b.md") + "similarity index 90%\nrename from memory/a.md\nrename to memory/b.md\n", None, "renames", "memory/b.md"),
    ("ok", "--- a/memory/a.md\n+++ /dev/null\n@@ -1,3 +0,0 @@\n-one\n-two\n-three\n", None, "deletes", "memory/a.md"),
    ("ok", "--- a/memory/a.md\n+++ b/memory/a.md\n@@ -1,2 +1,2 @@\n-one\n+one\n two\n", None, "unchanged", None),
    ("ok", "--- /dev/null\n+++ b/src/main.go\n@@ -0,0 +1 @@\n+x\n", None, "misplaced", "src/main.go"),
    ("ok", "--- /dev/null\n+++ b/memory/n.md\n@@ -0,0 +1 @@\n+x\n--- a/system-prompt.md\n+++ b/system-prompt.md\n@@ -1 +1 @@\n-You are.\n+You were.\n", None, "many-surfaces", "memory, system-prompt"),
    ("ok", "--- /dev/null\n+++ b/memory/n.md\n@@ -0,0 +1 @@\n+x\n--- /dev/null\n+++ b/memory/m.md\n@@ -0,0 +1 @@\n+x\n", None, "many-files", "memory/m.md"),
    ("ok", "--- a/memory/a.md\n+++ b/memory/a.md\n@@ -1,3 +1 @@\n-one\n-two\n-three\n+ \n", None, "empty", "memory/a.md"),
    ("ok", "--- /dev/null\n+++ b/memory/n.md\n@@ -0,0 +1 @@\n+a\tb\n", None, "tab", "memory/n.md"),
    ("ok", HEAD.format("memory/n.md") + "new file mode 100644\n--- /dev/null\n+++ b/memory/n.md\n@@ -0,0 +1,2 @@\n+x\n+\n", ("memory", "auto", ["memory/n.md"], "add", "x", False), None, None),
    ("ok", "Why.\n--- a/memory/a.md\n+++ b/memory/a.md\n@@ -2,2 +2,2 @@\n two\n-three\n+3\n\\ No newline at end of file\n", ("memory", "auto", ["memory/a.md"], "rewrite", "one\ntwo\n3", False), None, None),
    ("ok", "--- a/system-prompt.md\n+++ b/system-prompt.md\n@@ -1 +1 @@\n-You are.\n+You\tmay.\n", ("system-prompt", "human", ["system-prompt.md"], "amend", None, True), None, None),
    ("ok", "--- /dev/null\n+++ b/skills/go/SKILL.md\n@@ -0,0 +1 @@\n+how\n", ("skill", "auto", ["skills/go/SKILL.md"], "add", "how", False), None, None),
]


@pytest.fixture(scope="module")
def made(spark):
    rows = [(i, status, "h", diff) for i, (status, diff, _, _, _) in enumerate(CASES)]
    candidates = spark.createDataFrame([*rows, (99, "ok", "h", None), (98, None, "h", None)], "id int, status string, harness string, diff string").repartition(3)
    harness = spark.createDataFrame([("h", "memory/a.md", "one\ntwo\nthree\n"), ("h", "system-prompt.md", "You are.\n"), ("other", "memory/none.md", "one\n")], "harness string, path string, body string")
    return {r.id: r for r in diffs.edits(candidates, harness).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_edits(made, i):
    _, _, want, refusal, detail = CASES[i]
    r = made[i]
    assert (r.refusal, r.detail) == (refusal, detail)
    if want is not None:
        assert (r.component, r.approval, r.paths, r.verb, r.body, r.diff_sha256 is not None) == want
    assert made[99].refusal == made[98].refusal == "not-ok" and len(made) == len(CASES) + 2


def test_few_rows_are_python_objects_at_once():
    """A batch of Spark's is taken in pieces, by rows and by bytes, none lost; an empty one gives none."""
    import pyarrow as pa

    def sizes(texts):
        batch = pa.RecordBatch.from_pydict({"k": pa.array(range(len(texts)), pa.int64()), "t": pa.array(texts, pa.string())})
        got = list(diffs.pieces(iter([batch, batch.slice(0, 0)])))
        assert [k for b in got for k in b.column("k").to_pylist()] == list(range(len(texts)))
        return [b.num_rows for b in got]

    assert sizes(["a"] * 150) == [64, 64, 22] and sizes([]) == []
    assert sizes(["a" * 300_000] * 7) == [3, 3, 1] and sizes(["a" * 3_000_000] * 2) == [1, 1]


def test_diffs_beyond_a_piece(spark):
    pairs = [(k, f"a\nb{k}\nc\n", f"a\nb{k + k % 2}\nc\n") for k in range(200)]
    df = spark.createDataFrame(pairs, "k long, x string, y string").coalesce(1)
    got = {r.k: r.diff for r in diffs.line_diffs(df, "x", "y").collect()}
    assert got == {k: diffs.diff_lines(x, y) for k, x, y in pairs}
