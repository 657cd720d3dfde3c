import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import packets
from tallyforge.sources.paged import paged_rows

ROWS = [{"row": {"id": i, "text": f"é {i}"}} for i in range(237)]


class Handler(BaseHTTPRequestHandler):
    seen: dict = {}
    lock = threading.Lock()

    def log_message(self, *args):
        pass

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        at, n = int(q["offset"]), int(q["length"])
        with self.lock:
            times = self.seen[at, n] = self.seen.get((at, n), 0) + 1
        wrong = q["dataset"] == "gone"
        code = 404 if wrong else {1: 429, 2: 503}.get(times, 200) if at % 100 == 0 else 200
        self.send_response(code)
        self.end_headers()
        if code == 200:
            self.wfile.write(json.dumps({"num_rows_total": len(ROWS), "rows": ROWS[at : at + n]}).encode())


@pytest.fixture(scope="module")
def endpoint():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/rows"
    server.shutdown()


FAST = {"pause": 0, "backoff": 0.01, "page": 20, "pagesPerTask": 3}


def test_pages_fail_twice_and_are_read(spark, endpoint):
    df = paged_rows(spark, endpoint, dataset="d", config="c", split="train", **FAST)
    assert df.rdd.getNumPartitions() == 4
    got = sorted(df.collect())
    assert [(r.offset, json.loads(r.row)) for r in got] == [(i, x["row"]) for i, x in enumerate(ROWS)]
    assert max(Handler.seen.values()) >= 3


def test_limit_and_refusal(spark, endpoint):
    assert sorted(r.offset for r in paged_rows(spark, endpoint, dataset="d", limit=70, **FAST).collect()) == list(range(70))
    Handler.seen.clear()
    with pytest.raises(Exception, match="offset 0"):
        paged_rows(spark, endpoint, dataset="gone", **FAST).collect()
    assert set(Handler.seen.values()) <= {1, 2}  # a refusal is not asked again (Spark may plan twice)


CANDIDATES = [(i, f"c{j}", f"body {i} {j}") for i in range(12) for j in range(1 + i % 30)] + [(50, f"c{j}", None) for j in range(30)]


def answer(rows, **changes):
    one = rows[0]
    return {"item": one.item, "annotator": one.annotator, "packet_sha256": one.packet_sha256, "mapping_sha256": one.mapping_sha256, "acceptable": [], "all_bad": True, "rationale": "read"} | changes


ANSWERS = "item int, annotator string, packet_sha256 string, mapping_sha256 string, acceptable array<string>, all_bad boolean, rationale string"


def test_packet_round_trip_and_tampering(spark):
    candidates = spark.createDataFrame(CANDIDATES, "item int, candidate string, body string")
    made = packets.packet(candidates, "ann", "secret")
    rows = made.collect()
    by = {i: sorted((r for r in rows if r.item == i), key=lambda r: (len(r.label), r.label)) for i in {r.item for r in rows}}
    assert [r.label for r in by[50]] == [*"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "AA", "AB", "AC", "AD"]
    assert [r.candidate for r in by[11]] != sorted(r.candidate for r in by[11])  # shuffled
    assert {(r.item, r.candidate): r.label for r in packets.packet(candidates, "ann", "secret").collect()} == {(r.item, r.candidate): r.label for r in rows}
    assert {(r.item, r.candidate): r.label for r in packets.packet(candidates, "other", "secret").collect()} != {(r.item, r.candidate): r.label for r in rows}
    labels = lambda i, *names: [next(r.label for r in by[i] if r.candidate == n) for n in names]
    good = [answer(by[2], acceptable=labels(2, "c1", "c0"), all_bad=False), answer(by[3]), answer(by[50], acceptable=["AC"], all_bad=False)]
    bad = [
        ("annotator", answer(by[4], annotator="else")), ("packet-changed", answer(by[5], packet_sha256="0" * 64)), ("mapping-changed", answer(by[6], mapping_sha256=by[5][0].mapping_sha256)),
        ("no-rationale", answer(by[7], rationale="  ")), ("unknown-label", answer(by[8], acceptable=["Z"], all_bad=False)), ("repeated-label", answer(by[9], acceptable=["A", "A"], all_bad=False)),
        ("choice", answer(by[10], acceptable=["A"])), ("choice", answer(by[11], all_bad=False)), ("unknown-item", answer(by[1], item=99)),
    ]
    repeated = [answer(by[1]), answer(by[1], rationale="again")]
    answers = spark.createDataFrame([*good, *(a for _, a in bad), *repeated], ANSWERS)
    got = {r.item: r for r in packets.import_answers(made, answers).collect()}
    assert got[2].acceptable == ["c0", "c1"] and got[3].all_bad and got[50].acceptable == [by[50][28].candidate] and {got[i].refusal for i in (2, 3, 50)} == {None}
    assert {a["item"]: got[a["item"]].refusal for _, a in bad} == {a["item"]: why for why, a in bad}
    assert got[1].refusal == "repeated-item" and got[0].refusal == "unanswered" and got[4].acceptable is None
    changed = packets.packet(candidates.withColumn("body", F.when((F.col("item") == 2) & (F.col("candidate") == "c0"), "new").otherwise(F.col("body"))), "ann", "secret")
    assert packets.import_answers(changed, answers).where("item = 2").first().refusal == "packet-changed"


ITEMS = "source string, source_id string, cluster string, conversation_sha256 string"


def test_claims(spark, tmp_path):
    items = spark.createDataFrame([("s", str(i), f"c{i // 3}", f"d{i}") for i in range(9)], ITEMS).repartition(4)
    states = lambda df: sorted({r.state for r in df.collect()})
    first = packets.claim(items, str(tmp_path), "one")
    assert states(first) == ["claimed"] and first.count() == 9 + 9 + 3  # run again as a whole: the same answer
    assert states(packets.claim(items, str(tmp_path), "one")) == ["refused"]  # a second start without resume
    assert states(packets.claim(items, str(tmp_path), "one", resume=True)) == ["claimed"]
    assert states(packets.claim(items.limit(2), str(tmp_path), "two")) == ["refused"]
    other = spark.createDataFrame([("s", "0", "c0", "new text")], ITEMS)  # the same source with another text
    assert {r.key_kind: r.state for r in packets.claim(other, str(tmp_path), "one", resume=True).collect()} == {"conversation": "claimed", "source": "refused", "source_cluster": "claimed"}


def test_of_two_claims_at_once_one_wins(spark, tmp_path):
    items = spark.createDataFrame([("s", "1", "c", "d")], ITEMS)
    out = {}
    run = lambda name: out.setdefault(name, [r.state for r in packets.claim(items, str(tmp_path), name).collect()])
    both = [threading.Thread(target=run, args=(n,)) for n in ("one", "two")]
    [t.start() for t in both]
    [t.join() for t in both]
    for one, two in zip(out["one"], out["two"], strict=True):
        assert {one, two} == {"claimed", "refused"}
