import copy
import hashlib
import json

import pytest

from tallyforge.sources import cards

GOOD = {
    "schema_version": 1, "id": "t1", "hypothesis": "h", "change": "c", "stage": "B", "suite": "s", "manifests": ["d.json"], "base": {"id": "a", "config": "a.json"}, "candidate": {"id": "b", "config": "b.json"},
    "reuse": {"kind": ""}, "rules": {"kind": "speed", "max_time_ratio": 0.8, "targets": ["x"]}, "take": {"D": 3},
}
WRONG = {
    "version": {"schema_version": 2}, "no-id": {"id": ""}, "no-hypothesis": {"change": None}, "stage": {"stage": "D"}, "no-suite": {"suite": ""}, "no-manifest": {"manifests": []},
    "unnamed-condition": {"base": {"config": "a"}}, "one-condition": {"base": {"id": "b", "config": "a"}}, "no-configuration": {"candidate": {"id": "b"}}, "rule": {"rules": {"kind": "luck"}},
    "reuse": {"reuse": {"kind": "other"}}, "reuse-source": {"reuse": {"kind": "trial"}}, "budget": {"budget_seconds": -1}, "take": {"take": {"X": 1}}, "max-items": {"max_items": -1},
    "planning": {"planning": {"item_seconds": -1}}, "switch": {"base": {"id": "a", "config": "a", "switch": {"command": " "}}},
}


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("cards")
    for name, change in {"good": {}, **WRONG}.items():
        (where / f"{name}.json").write_text(json.dumps(copy.deepcopy(GOOD) | change, indent=1))
    (where / "not-json.json").write_text('{"schema_version": ')
    return {r.file.rsplit("/", 1)[-1][:-5]: r for r in cards.trial_cards(spark, str(where)).collect()}


@pytest.mark.parametrize("name", [*WRONG, "not-json"])
def test_faults_of_trial_cards(read, name):
    assert read[name].fault == name


def test_defaults_of_trial_cards(read):
    r = read["good"]
    assert (r.fault, r.budget_seconds, r.block_size, r.min_items_per_category, r.min_evaluable_items, r.reuse.kind, r.least_points, r.most_time) == (None, 1800, 4, 4, 8, "none", -2.0, 0.8)


def test_manifests(spark, tmp_path):
    item = lambda i, **k: {"id": i} | k
    made = {
        "good": [item("a", order=1, strata={"k": "x", "z": "free"}), item("b", order=2)], "no-items": [], "no-id": [item("")], "repeated-id": [item("a"), item("a")], "order": [item("a", order=1), item("b", order=3)],
        "two-buckets": [item("a", strata={"k": "x", "l": "y"})],
    }
    for name, items in made.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"schema_version": 1, "set": "D", "items": items, "weights": {"x": 0.5, "y": 0.5}}))
    (tmp_path / "set.json").write_text(json.dumps({"schema_version": 1, "set": "Q", "items": made["good"]}))
    (tmp_path / "weight.json").write_text(json.dumps({"schema_version": 1, "set": "R", "items": made["good"], "weights": {"x": -1}}))
    got = {r.file.rsplit("/", 1)[-1][:-5]: r for r in cards.manifests(spark, str(tmp_path)).collect()}
    assert {n: r.fault for n, r in got.items()} == {n: None if n == "good" else n for n in got}
    assert [(i.id, i.place, i.bucket) for i in got["good"]["items"]] == [("a", 1, "x"), ("b", 2, "")]


def test_pins_of_assessment_cards(spark, tmp_path):
    pin = lambda name, text: {"path": name, "sha256": hashlib.sha256(text.encode()).hexdigest()}
    card = {"schema_version": 1, "id": "as", "finalist": {"report": pin("r.json", "report"), "resume": pin("gone.json", "x"), "results": pin(f"{tmp_path}/files/results.jsonl", "rows")}, "dataset": pin("files/d.json", "as it was"), "labels": pin("r.json", "report")}
    (tmp_path / "files").mkdir()
    for name, text in (("r.json", "report"), ("files/results.jsonl", "rows"), ("files/d.json", "changed"), ("card.json", json.dumps(card))):
        (tmp_path / name).write_text(text)
    got = {r.what: (r.pinned, r.now is None) for r in cards.assessment_pins(spark, f"{tmp_path}/card.json").collect()}
    assert got == {"report": (True, False), "resume": (False, True), "results": (True, False), "dataset": (False, False), "labels": (True, False)}
