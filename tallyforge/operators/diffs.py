"""Differences of texts by lines, unified diffs read as files and hunks, and the edits that candidates' diffs make of a harness."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import component

CONTEXT = 3
#: Rows that are Python objects at once, in texts of this many bytes together (one row at least).
PIECE_ROWS, PIECE_BYTES = 64, 1 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, few at a time: a batch of Spark's has up to 10 000, whatever their texts."""
    for batch in batches:
        rows = max(1, min(PIECE_ROWS, PIECE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def lines_of(text: str | None) -> list[str]:
    """Lines without the empty piece that a final line feed leaves."""
    lines = (text or "").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def script(before: list[str], after: list[str]) -> Iterator[tuple[str, str]]:
    """The steps from one text to the other that keep a longest common subsequence of lines: ' ', '-' or '+', and the line.

    The length that is left from a place is max(below, right, diagonal + 1 where the lines are equal); a row of these lengths
    follows from the row below by one running maximum. Every k-th row is kept and the others are made again block by block, so
    memory grows with the square root of the lines times the lines. Equal lines are kept at once; else a line goes if no fewer are
    kept below."""
    known: dict[str, int] = {}
    a, b = (np.array([known.setdefault(x, len(known)) for x in side], np.int64) for side in (before, after))
    n, m = len(a), len(b)
    step = max(1, isqrt(n))

    def row(i: int, below: np.ndarray) -> np.ndarray:
        here = np.where(b == a[i], below[1:] + 1, below[:-1])
        return np.append(np.maximum.accumulate(here[::-1])[::-1], 0).astype(np.int32)

    kept, last = {n: np.zeros(m + 1, np.int32)}, np.zeros(m + 1, np.int32)
    for i in range(n - 1, -1, -1):
        last = row(i, last)
        if i % step == 0:
            kept[i] = last
    block: dict[int, np.ndarray] = {}
    i = j = 0
    while i < n and j < m:
        if i not in block or i + 1 not in block:
            start, end = i // step * step, min(n, i // step * step + step)
            block = {end: kept[end]}
            for k in range(end - 1, start - 1, -1):
                block[k] = row(k, block[k + 1])
        if a[i] == b[j]:
            yield " ", before[i]
            i, j = i + 1, j + 1
        elif block[i + 1][j] >= block[i][j + 1]:
            yield "-", before[i]
            i += 1
        else:
            yield "+", after[j]
            j += 1
    yield from (("-", x) for x in before[i:])
    yield from (("+", x) for x in after[j:])


def hunks(steps: list[tuple[str, str]], context: int = CONTEXT) -> Iterator[tuple[int, int, int, int, list[str]]]:
    """Old start and count, new start and count, and lines of every run of changes with the lines around it."""
    changed = np.array([kind != " " for kind, _ in steps], bool)
    near = changed.copy()
    for d in range(1, context + 1):
        near[d:] |= changed[:-d]
        near[:-d] |= changed[d:]
    old = np.concatenate([[0], np.cumsum([kind != "+" for kind, _ in steps])])
    new = np.concatenate([[0], np.cumsum([kind != "-" for kind, _ in steps])])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(np.int8), [0]])))
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        yield int(old[s]) + 1, int(old[e] - old[s]), int(new[s]) + 1, int(new[e] - new[s]), [k + x for k, x in steps[s:e]]


def diff_lines(before: str | None, after: str | None, context: int = CONTEXT) -> list[str]:
    """Hunk heads and lines; nothing for texts of equal lines."""
    steps, out = [*script(lines_of(before), lines_of(after))], []
    for a, n, b, m, lines in hunks(steps, context):
        out += [f"@@ -{a},{n} +{b},{m} @@", *lines]
    return out


def line_diffs(df: DataFrame, before: str, after: str, context: int = CONTEXT) -> DataFrame:
    """SC-15: df with diff, the hunks from one text column to the other as lines (an empty array where they are equal)."""
    inner = [c for c in df.columns if c not in (before, after)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            pairs = zip(batch.column(before).to_pylist(), batch.column(after).to_pylist(), strict=True)
            found = pa.array([diff_lines(a, b, context) for a, b in pairs], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "diff"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, diff array<string>").select(*inner, before, after, "diff")


# How a unified diff marks files, their modes and hunks.
HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
FILE_MARKS = {"new file mode": "A", "deleted file mode": "D", "rename from": "R", "rename to": "R", "copy from": "C", "copy to": "C"}
FILES = "array<struct<path: string, status: string, hunks: array<struct<old: int, lines: array<string>>>>>"
NO_FILE = "/dev/null"


def plain_path(mark: str) -> str:
    """The path of a file line, without its prefix and what follows a tab."""
    path = mark.split("\t")[0].strip()
    return path[2:] if path[:2] in ("a/", "b/") else path


def read_diff(text: str | None) -> list[dict] | None:
    """Files with path, status (A, M, D, R, C) and hunks of a unified diff, in path order; None where its hunks are not whole or it has no file.

    A state machine over lines: a head says which file comes and what becomes of it, a hunk takes as many old and new lines as
    it tells, and anything else between hunks is passed over."""
    files: list[dict] = []
    lines, at = (text or "").split("\n"), 0
    current: dict | None = None
    while at < len(lines):
        line = lines[at]
        at += 1
        if line.startswith("diff --git "):
            both = line[len("diff --git ") :]
            current = {"path": plain_path("b/" + both.rsplit(" b/", 1)[-1]), "status": "M", "hunks": []}
            files.append(current)
        elif line.startswith("--- ") and at < len(lines) and lines[at].startswith("+++ "):
            old, new = plain_path(line[4:]), plain_path(lines[at][4:])
            at += 1
            if current is None or current["hunks"] or current.get("named"):
                current = {"path": new, "status": "M", "hunks": []}
                files.append(current)
            current["named"] = True
            current["path"] = old if new == NO_FILE else new
            current["status"] = "A" if old == NO_FILE else "D" if new == NO_FILE else current["status"]
        elif m := HUNK.match(line):
            if current is None:
                return None
            left, right = int(m[2] or 1), int(m[4] or 1)
            body: list[str] = []
            while left > 0 or right > 0:
                if at >= len(lines) or lines[at][:1] not in (" ", "-", "+", "\\", ""):
                    return None
                kind = lines[at][:1] or " "
                body.append(lines[at] or " ")
                left, right, at = left - (kind in " -"), right - (kind in " +"), at + 1
            if left or right:
                return None
            if at < len(lines) and lines[at].startswith("\\"):
                body.append(lines[at])
                at += 1
            current["hunks"].append({"old": int(m[1]), "lines": body})
        elif current is not None:
            for mark, status in FILE_MARKS.items():
                if line.startswith(mark):
                    current["status"] = status
                    if mark in ("rename to", "copy to"):
                        current["path"] = line[len(mark) + 1 :].strip()
    return sorted(({k: f[k] for k in ("path", "status", "hunks")} for f in files), key=lambda f: f["path"]) or None


def applied(body: str | None, changes: list[dict]) -> str | None:
    """A file's text after its hunks; None where one does not fit. A hunk fits where all its old lines stand, at its place or the nearest
    one to it; old lines are never guessed."""
    lines, moved, out_ended = lines_of(body), 0, body is None or body == "" or body.endswith("\n")
    for change in changes:
        old = [x[1:] for x in change["lines"] if x[0] in " -"]
        new = [x[1:] for x in change["lines"] if x[0] in " +"]
        if not old:
            at = min(len(lines), change["old"] + moved) if lines else 0
        else:
            want = change["old"] - 1 + moved
            fits = [k for k in range(len(lines) - len(old) + 1) if lines[k] == old[0] and lines[k : k + len(old)] == old]
            if not fits:
                return None
            at = min(fits, key=lambda k: (abs(k - want), k))
        lines[at : at + len(old)] = new
        moved = at - (change["old"] - 1) + len(new) - len(old) if old else moved + len(new)
        if at + len(new) == len(lines):  # the file's end is in the hunk: a mark under a new line says that it has no line feed
            marks = [i for i, x in enumerate(change["lines"]) if x[0] == "\\" and i and change["lines"][i - 1][0] in " +"]
            out_ended = not marks
    return "\n".join(lines) + ("\n" if lines and out_ended else "")


def changed_files(candidates: DataFrame) -> DataFrame:
    """All columns of candidates but diff, whether it could be read, and path, status and hunks of each of its files (null path: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.string()), ("status", pa.string()), ("hunks", pa.list_(pa.struct([("old", pa.int32()), ("lines", pa.list_(pa.string()))])))]))
        for batch in pieces(batches):
            files = pa.array([read_diff(x) for x in batch.column("diff").to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, files], [*batch.schema.names, "files"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema)
    read = candidates.mapInArrow(run, f"{kinds}, files {FILES}").drop("diff")
    return read.select("*", F.col("files").isNotNull().alias("readable"), F.explode_outer("files").alias("f")).drop("files").select("*", "f.*").drop("f")


# The surfaces whose edits a person need not approve.
AUTO_APPROVED = ["memory", "skill"]


def edits(candidates: DataFrame, harness: DataFrame) -> DataFrame:
    """What each candidate's diff makes of its harness: the parts of an edit, or why it is refused.

    candidates: id, status, harness, diff. harness: harness, path, body of every file. One row a candidate: id, refusal (null for
    an edit), detail, component, approval, paths, verb (add, rewrite, amend, change), body (of surfaces that keep a whole file) and
    diff_sha256 (of those that keep the diff).

    Refusals, the first that holds: not-ok (no diff to read), not-applicable (a hunk is not whole or does not fit, a new file is
    there or a changed one is not), renames, deletes (the first such path tells), unchanged, misplaced (a path without a place in a
    harness), many-surfaces, many-files (surfaces that keep one whole file), empty and tab (of that file). Files of one candidate
    are grouped by it; texts are joined by path."""
    status = F.coalesce("status", F.lit(""))
    ok = candidates.where((status == "ok") & (F.coalesce("diff", F.lit("")) != ""))
    refused = candidates.join(ok.select("id"), "id", "left_anti").select("id", F.lit("not-ok").alias("refusal"), F.col("status").alias("detail"))
    files = changed_files(ok.select("id", "harness", "diff")).join(harness.select("harness", "path", "body", F.lit(True).alias("there")), ["harness", "path"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = batch.select(["status", "hunks", "body", "there"]).to_pylist()
            made = [None if (r["status"] == "A") == bool(r["there"]) else applied(r["body"], r["hunks"] or []) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "path", "status", "body", "readable")), pa.array(made, pa.string())], ["id", "path", "status", "body", "readable", "made"])

    kind = candidates.schema["id"].dataType.simpleString()
    done = files.mapInArrow(run, f"id {kind}, path string, status string, body string, readable boolean, made string")
    moved = F.col("status").isin("R", "C", "D")
    differs = ~moved & ~F.coalesce(F.col("made") == F.col("body"), F.lit(False))
    fails = ~F.col("readable") | (F.col("made").isNull() & ~F.col("status").isin("R", "C"))
    own = F.struct("path", "status", component(F.col("path")).alias("component"), "made")
    g = done.groupBy("id").agg(
        F.bool_or(fails).alias("fails"), F.min(F.when(moved, F.struct("path", "status"))).alias("moved"), F.array_sort(F.collect_list(F.when(differs, own))).alias("files")
    )
    surfaces = F.array_sort(F.array_distinct("files.component"))
    misplaced = F.filter("files", lambda f: f["component"] == "refused")
    g = g.join(ok.select("id", F.sha2("diff", 256).alias("sha")), "id").withColumns({"surfaces": surfaces, "misplaced": misplaced, "text": F.replace(F.get("files", F.lit(0))["made"], F.lit("\r\n"), F.lit("\n"))})
    whole = F.get("surfaces", F.lit(0)) != "system-prompt"
    refusal = (
        F.when(F.col("fails"), "not-applicable").when(F.col("moved.status").isin("R", "C"), "renames").when(F.col("moved.status") == "D", "deletes").when(F.size("files") == 0, "unchanged")
        .when(F.size("misplaced") > 0, "misplaced").when(F.size("surfaces") > 1, "many-surfaces").when(whole & F.rlike("text", F.lit(r"^\s*$")), "empty")
        .when(whole & F.contains("text", F.lit("\t")), "tab").when(whole & (F.size("files") > 1), "many-files")
    )
    detail = (
        F.when(refusal.isin("renames", "deletes"), F.col("moved.path")).when(refusal == "misplaced", F.get("misplaced", F.lit(0))["path"]).when(refusal == "many-surfaces", F.array_join("surfaces", ", "))
        .when(refusal.isin("empty", "tab", "many-files"), F.get("files", F.lit(0))["path"])
    )
    named = g.withColumns({"refusal": refusal, "detail": detail})
    fine = lambda c: F.when(F.col("refusal").isNull(), c)
    one, verb_of_one = F.size("files") == 1, F.when(F.get("files", F.lit(0))["status"] == "A", "add").otherwise("rewrite")
    full = named.select(
        "id", "refusal", "detail", fine(F.get("surfaces", F.lit(0))).alias("component"), fine(F.when(F.get("surfaces", F.lit(0)).isin(AUTO_APPROVED), "auto").otherwise("human")).alias("approval"),
        fine(F.col("files.path")).alias("paths"), fine(F.when(~whole, "amend").when(one, verb_of_one).otherwise("change")).alias("verb"),
        fine(F.when(whole, F.btrim("text", F.lit("\n")))).alias("body"), fine(F.when(~whole, F.col("sha"))).alias("diff_sha256"),
    )
    return full.unionByName(refused, allowMissingColumns=True)
