import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import heads
from tallyforge.sources import readers, writers

words = st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\x85  "), max_size=12)
leaves = st.one_of(st.none(), st.booleans(), st.integers(-(10**9), 10**9), st.floats(allow_nan=False, allow_infinity=False, width=32), words)
values = st.recursive(leaves, lambda c: st.one_of(st.lists(c, max_size=4), st.dictionaries(words, c, max_size=4)), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(words, values, max_size=5))
def test_what_is_written_is_read_back(value):
    assert heads.parse(heads.render(value)) == value


TEXT = """# a comment
edit_id: he-0001
title: 'It''s: one'
count: 3
share: 0.50
on: true
none:
inline: [a, "b, c", 3]
touches:
- memory
- skill
predicts:
  - pattern: fp/x
    expect: fix
    seen:
      - 1
  - pattern: "fp/y"
deep:
  er:
    text: >-
      folded over
      lines

      and more
  literal: |
    keeps
      its indent
last: end
"""


def test_every_kind_of_value():
    assert heads.parse(TEXT) == {
        "edit_id": "he-0001", "title": "It's: one", "count": 3, "share": 0.5, "on": True, "none": None, "inline": ["a", "b, c", 3], "touches": ["memory", "skill"],
        "predicts": [{"pattern": "fp/x", "expect": "fix", "seen": [1]}, {"pattern": "fp/y"}], "deep": {"er": {"text": "folded over lines\nand more"}, "literal": "keeps\n  its indent\n"}, "last": "end",
    }
    assert heads.parse("") == {} and heads.parse("a: {}\nb: []") == {"a": {}, "b": []}


@pytest.mark.parametrize("text", ["a: 1\na: 2", "just words", "a: 1\n  b: 2", "\ta: 1", 'a: "open', "a: 'open", "a: &x 1", "- 1\nb: 2", "a: {b: 1}"])
def test_what_is_not_known_is_told(text):
    with pytest.raises(heads.Malformed):
        heads.parse(text)


def test_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text(f"---\n{TEXT}---\nThe body, see [[x]].\n")
    (tmp_path / "b.md").write_text("no head\n")
    (tmp_path / "c.md").write_text("---\na: 1\na: 2\n---\n")
    got = {r.path.rsplit("/", 1)[-1]: r for r in readers.heads(spark, str(tmp_path)).collect()}
    assert json.loads(got["a.md"].head) == heads.parse(TEXT) and got["a.md"].body == "The body, see [[x]].\n"
    assert (got["b.md"].head, got["b.md"].fault, got["b.md"].body) == (None, "no-head", "no head\n") and (got["c.md"].head, got["c.md"].fault) == (None, "malformed")
    texts = [r.t for r in readers.heads(spark, str(tmp_path)).where("fault is null").select(writers.nested_document(F.col("head"), F.col("body")).alias("t")).collect()]
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "a.md").write_text(texts[0])
    again = readers.heads(spark, f"{tmp_path}/again").first()
    assert (again.head, again.body) == (got["a.md"].head, got["a.md"].body)
    typed = readers.heads(spark, str(tmp_path)).where("fault is null").select(F.from_json("head", "predicts array<struct<pattern: string, expect: string>>").alias("h")).first()
    assert [p.pattern for p in typed.h.predicts] == ["fp/x", "fp/y"]
