"""The sequential gate as a stateful stream: arms of a pair meet in state, evidence and tasks are kept by split, and a reading comes for
each pair that is whole."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyforge.operators.sequential import Params

OUT = "split string, pair_id long, kind string, outcome int, cum_b long, cum_c long, cum_ties long, lost_tasks long, log_e double, decided string"
PAIR, TASK = "arm string, passed boolean, answered boolean, task string, repeats int", "complete int, lost int, repeats int"
SPLIT = "b long, c long, ties long, lost_tasks long, decided string, fingerprint string"
#: What keeps the state of the stream; the state of this operator needs it.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def log_e(b: int, c: int) -> float:
    return math.lgamma(b + 1) + math.lgamma(c + 1) - math.lgamma(b + c + 2) + (b + c) * math.log(2)


def fingerprint(p: Params, note: str = "") -> str:
    """What a run must share with the one that it resumes."""
    return hashlib.sha256(json.dumps([p.alpha, p.margin, p.most_lost, note]).encode()).hexdigest()


class Gate(StatefulProcessor):
    """State of a split: `pairs`, arms that wait for the other one, and pairs that are whole (no arm); `tasks`, whole pairs and lost ones
    of each; `split`, the evidence and the fingerprint of the run that began it."""

    def __init__(self, p: Params, mark: str) -> None:
        self.gain, self.harm, self.most_lost, self.mark = math.log(2 / p.alpha), math.log(1 / p.alpha), p.most_lost, mark

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pairs, self.tasks = handle.getMapState("pairs", "pair_id long", PAIR), handle.getMapState("tasks", "task string", TASK)
        self.split = handle.getValueState("split", SPLIT)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        b, c, ties, lost, decided, mark = self.split.get() if self.split.exists() else (0, 0, 0, 0, "", self.mark)
        if mark != self.mark:
            raise RuntimeError(f"split {key[0]} was begun with other settings (fingerprint {mark[:12]}, now {self.mark[:12]}); it is not resumed")
        out = []

        def tell(pair: int, kind: str, outcome: int | None) -> None:
            out.append((key[0], pair, kind, outcome, b, c, ties, lost, log_e(b, c), decided))

        frame = pd.concat(list(rows)).sort_values(["pair_id", "arm"], kind="stable")
        for pair, arm, passed, error, task, repeats in frame[["pair_id", "arm", "passed", "error_class", "task_id", "task_repeats"]].itertuples(index=False):
            pair, at = int(pair), (int(pair),)
            waiting = self.pairs.getValue(at) if self.pairs.containsKey(at) else None
            if arm not in ("base", "edit") or (waiting is not None and waiting[0] in ("", arm)):
                tell(pair, "anomaly", None)  # an arm that is none, or a row too many
                continue
            answered = error == "none"
            if waiting is None:
                self.pairs.updateValue(at, (arm, bool(passed) if answered else False, answered, str(task), int(repeats)))
                continue
            self.pairs.updateValue(at, ("", False, False, "", 0))
            both = answered and waiting[2]
            base, edit = (bool(passed), waiting[1]) if arm == "base" else (waiting[1], bool(passed))
            outcome = int(edit) - int(base) if both else None
            done = (str(task),)
            complete, losses, planned = self.tasks.getValue(done) if self.tasks.containsKey(done) else (0, 0, int(repeats))
            complete, losses = complete + both, losses + (outcome == -1)
            self.tasks.updateValue(done, (int(complete), int(losses), planned))
            if decided:  # what comes after the decision is held, and not read
                continue
            if not both:
                tell(pair, "pending", None)
                continue
            b, c, ties = b + (outcome == 1), c + (outcome == -1), ties + (outcome == 0)
            lost += outcome == -1 and losses == planned
            e = log_e(b, c)
            if (c > b and e >= self.harm) or (self.most_lost >= 0 and lost > self.most_lost):
                decided = "regress"
            elif b > c and e >= self.gain:
                decided = "improve"
            tell(pair, "reading", outcome)
        self.split.update((int(b), int(c), int(ties), int(lost), decided, mark))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")]).astype({"outcome": "Int32"})


def gate_stream(arms: DataFrame, p: Params = Params(), note: str = "") -> DataFrame:
    """A row for each pair that is whole (`reading`, or `pending` if an arm has no answer) until its split is decided, and for each row that
    has no place (`anomaly`): a repeated arm, or one that is neither base nor edit.

    arms: split, pair_id, arm, passed, error_class, task_id, task_repeats (the pairs planned of the task). Arms may come in any trigger;
    within one, pairs go by pair_id. Evidence, lost tasks and waiting arms are in state, so a stream that is killed goes on from its
    checkpoint; with other settings or another note it fails instead. Needs the state store of PROVIDER."""
    return arms.groupBy("split").transformWithStateInPandas(Gate(p, fingerprint(p, note)), OUT, "Append", "None")


def half_pairs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """split, pair_id and arm of the pairs that still lack an arm, read from a stream's checkpoint: anomalies, once the run is over."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "pairs").load()
    return state.selectExpr("key.split split", "user_map_key.pair_id pair_id", "user_map_value.arm arm").where("arm <> ''")
