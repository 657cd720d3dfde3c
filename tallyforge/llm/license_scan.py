"""License scans: Dice coefficient over word bigrams against templates.

Each line of a text, and the text as a whole, is normalised and compared with every template whose
size allows the asked Dice value: with A and B bigrams it is at most 2 min(A, B) / (A + B), so only
units of B t / (2 - t) to B (2 - t) / t bigrams can reach t. Bigrams count as often as they stand;
a template has none twice. All of it is one projection over the rows: nothing is shuffled.

Notices wrapped over lines or standing inside longer ones, cut, or with words put in, and full licence
texts, are found as passages: runs of bigrams of every admissible size over the words of the whole text.
A run that does not start and end with one of the template's bigrams shares no more than the shorter one
that does, so only those are scored: from each such start, one fold over the places of the template's
bigrams that follow, with the bigrams met so far as bits. A run that reaches t misses at most
B (2 - 2t) / (2 - t) of the template's bigrams; of one more, its probes, it has one at least, and texts
without any probe are passed over. A passage counts, with its best score, at the line on which it starts.

Defined cases: a null or empty text has no hit; units of fewer than two words have no bigram; among
equal scores the license that sorts first wins, then the earliest unit (the whole text is line 0);
a passage and a line of one license that start on one line are one hit;
repeated rows each give a row; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
# Common public license notices and sentences of full license texts, by SPDX identifier.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def normal_words(text: str) -> list[str]:
    return re.sub(r"[^A-Za-z0-9]+", " ", text).lower().split()


def template_rows(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """Name and bigrams of each template, checked to have none twice."""
    out = []
    for name, text in templates:
        words = normal_words(text)
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        if len(set(pairs)) != len(pairs) or not 0 < len(pairs) < 64:
            raise ValueError(f"template of {name} has no bigram, one twice, or over 63")
        out.append((name, pairs))
    return out


def bounds(n: int, threshold: float) -> tuple[float, float]:
    """Fewest and most bigrams of a unit that can reach the threshold against n."""
    return n * threshold / (2 - threshold) - 1e-9, n * (2 - threshold) / threshold + 1e-9


def words_by_line(text: Column) -> Column:
    """Normal words of each line: runs of ASCII letters and digits, lower-cased."""
    clean = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9\n]+", " "))
    return F.transform(F.split(clean, "\n"), lambda line: F.array_remove(F.split(line, " "), ""))


def pairs_of(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def known_templates(rows: list[tuple[str, list[str]]], threshold: float) -> Column:
    spans = [bounds(len(p), threshold) for _, p in rows]
    return F.array(*(
        F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, p)).alias("bigrams"), F.lit(a).alias("least"), F.lit(b).alias("most"))
        for (n, p), (a, b) in zip(rows, spans, strict=True)
    ))


def probes(pairs: list[str], threshold: float) -> list[str]:
    """The longest bigrams of a template, one more than a passage that reaches the threshold can miss."""
    missed = int(len(pairs) * (2 - 2 * threshold) / (2 - threshold) + 1e-9)
    return sorted(pairs, key=lambda x: (-len(x), x))[: missed + 1]


def given(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def passages(lines: Column, threshold: float, templates=TEMPLATES) -> Column:
    """score, license and first line of every passage that reaches the threshold. lines: words_by_line."""
    rows = template_rows(templates)
    known, words = known_templates(rows, threshold), lambda xs: F.array(*map(F.lit, sorted(set(xs))))
    probe, some_bigram = words(x for _, p in rows for x in probes(p, threshold)), words(x for _, p in rows for x in p)

    bits = F.array(*(F.lit(1 << i).cast("long") for i in range(63)))

    def of_template(t: Column, marked: Column, line_of: Column) -> Column:
        size, most = F.size(t["bigrams"]), F.ceil(t["most"]).cast("int")

        def best(m: Column, inside: Column) -> Column:  # of the runs from m on
            def step(acc: Column, s: Column) -> Column:
                seen = acc["seen"].bitwiseOR(s["bit"])
                return F.struct(seen.alias("seen"), F.greatest(acc["best"], 2.0 * F.bit_count(seen) / (s["at"] - m["at"] + 1 + size)).alias("best"))

            return F.aggregate(inside, F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("best")), step, lambda acc: F.round(acc["best"], 9))

        def scored(at: Column) -> Column:  # the template's bigrams of the text in order
            inside = lambda m, j: F.filter(F.slice(at, j + 1, most), lambda s: s["at"] < m["at"] + most)
            return F.transform(at, lambda m, j: F.struct(
                best(m, inside(m, j)).alias("score"), t["license"].alias("license"), F.get(line_of, m["at"]).cast("long").alias("line"),
            ))

        place = lambda s: F.array_position(t["bigrams"], s["pair"]).cast("int")
        mine = F.transform(F.filter(marked, lambda s: F.array_contains(t["bigrams"], s["pair"])), lambda s: F.struct(s["at"].alias("at"), F.element_at(bits, place(s)).alias("bit")))
        return F.filter(given(mine, scored), lambda x: x["score"] >= threshold)

    def of_text(pairs: Column) -> Column:
        line_of = F.flatten(F.transform(lines, lambda w, i: F.array_repeat(i + 1, F.size(w))))
        marked = F.filter(F.transform(pairs, lambda p, i: F.struct(i.alias("at"), p.alias("pair"))), lambda s: F.array_contains(some_bigram, s["pair"]))
        found = given(F.struct(marked.alias("marked"), line_of.alias("line_of")), lambda v: F.transform(known, lambda t: of_template(t, v["marked"], v["line_of"])))
        none = F.array().cast("array<struct<score: double, license: string, line: bigint>>")
        return F.when(F.arrays_overlap(pairs, probe), F.flatten(found)).otherwise(none)

    return given(pairs_of(F.flatten(lines)), of_text)


def hits(lines: Column, threshold: float, templates=TEMPLATES) -> Column:
    """score, license and line of every unit and template that reach the threshold. lines: words_by_line."""
    rows = template_rows(templates)
    spans = [bounds(len(p), threshold) for _, p in rows]
    least, most = min(a for a, _ in spans), max(b for _, b in spans)
    known = known_templates(rows, threshold)
    some_bigram = F.array(*map(F.lit, sorted({x for _, p in rows for x in p})))
    units = F.transform(F.concat(F.array(F.flatten(lines)), lines), lambda w, i: F.struct(i.cast("long").alias("line"), w.alias("words")))
    near = F.filter(units, lambda u: (F.size(u["words"]) > F.lit(least + 1)) & (F.size(u["words"]) < F.lit(most + 1)))

    def with_pairs(u: Column) -> Column:
        return F.struct(u["line"].alias("line"), pairs_of(u["words"]).alias("pairs"))

    # without a bigram in common the value is 0, whatever the template
    touched = F.filter(F.transform(near, with_pairs), lambda u: F.arrays_overlap(u["pairs"], some_bigram))

    def against(u: Column) -> Column:
        fitting = F.filter(known, lambda t: (F.size(u["pairs"]) >= t["least"]) & (F.size(u["pairs"]) <= t["most"]))
        scored = F.transform(
            fitting,
            lambda t: F.struct(
                F.round(2.0 * F.size(F.array_intersect(u["pairs"], t["bigrams"])) / (F.size(u["pairs"]) + F.size(t["bigrams"])), 9).alias("score"),
                t["license"].alias("license"),
                u["line"].alias("line"),
            ),
        )
        return F.filter(scored, lambda x: x["score"] >= threshold)

    return F.flatten(F.transform(touched, against))


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_lines, n_hits (lines, passages or the whole text that reach the threshold, by license and line), best license,
    score and line, and all licenses."""
    split = docs.select("doc_id", (F.coalesce("text", F.lit("")) == "").alias("empty"), words_by_line(F.col("text")).alias("lines"))
    n_lines = F.when(F.col("empty"), 0).otherwise(F.size("lines")).cast("long").alias("n_lines")
    found = split.select("doc_id", n_lines, F.concat(hits(F.col("lines"), threshold, templates), passages(F.col("lines"), threshold, templates)).alias("hits"))
    order = F.transform(F.col("hits"), lambda h: F.struct((-h["score"]).alias("s"), h["license"].alias("license"), h["line"].alias("line")))
    best = F.array_min(order)
    return found.select(
        "doc_id", "n_lines",
        F.size(F.array_distinct(F.transform("hits", lambda h: F.struct(h["license"], h["line"])))).cast("long").alias("n_hits"),
        best["license"].alias("license"), (-best["s"]).alias("score"), best["line"].alias("line"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",").alias("licenses"),
    )


def oracle_sql(threshold: float = THRESHOLD, templates=TEMPLATES) -> str:
    """The same over the view documents, for DuckDB."""
    values = ", ".join(f"({i}, '{n}', [{', '.join(repr(x) for x in p)}])" for i, (n, p) in enumerate(template_rows(templates)))
    return rf"""
WITH t(tid, license, bigrams) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
       lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9\n]+', ' ', 'g')) AS clean FROM documents),
u AS (SELECT rid, 0 AS line, replace(clean, chr(10), ' ') AS unit FROM d
      UNION ALL
      SELECT rid, unnest(range(1, len(string_split(clean, chr(10))) + 1)) AS line, unnest(string_split(clean, chr(10))) AS unit FROM d),
w AS (SELECT rid, line, list_filter(string_split(unit, ' '), lambda x: x <> '') AS words FROM u),
p AS (SELECT rid, line, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS pairs FROM w WHERE len(words) BETWEEN 2 AND 200),
h AS (SELECT rid, line, license, round(2.0 * len(list_intersect(list_distinct(pairs), bigrams)) / (len(pairs) + len(bigrams)), 9) AS score
      FROM p CROSS JOIN t),
v AS (SELECT rid, line, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM w WHERE line > 0),
o AS (SELECT rid, line, row_number() OVER run AS pos, word || ' ' || lead(word) OVER run AS pair FROM v WINDOW run AS (PARTITION BY rid ORDER BY line, k)),
m AS (SELECT rid, tid, license, line, pos, size, coalesce(lag(pos) OVER (PARTITION BY rid, tid, pair ORDER BY pos), 0) AS last
      FROM o JOIN (SELECT tid, license, len(bigrams) AS size, unnest(bigrams) AS pair FROM t) USING (pair)),
e AS (SELECT a.rid, a.line, a.license, b.pos - a.pos + 1 + a.size AS total,
        count(*) FILTER (b.last < a.pos) OVER (PARTITION BY a.rid, a.tid, a.pos ORDER BY b.pos) AS shared
      FROM m a JOIN m b ON a.rid = b.rid AND a.tid = b.tid AND b.pos BETWEEN a.pos AND a.pos + ceil(a.size * {(2 - threshold) / threshold}) - 1),
r AS (SELECT rid, line, license, max(round(2.0 * shared / total, 9)) AS score FROM e GROUP BY ALL),
g AS (SELECT rid, license, line, max(score) AS score FROM (SELECT rid, license, line, score FROM h UNION ALL SELECT rid, license, line, score FROM r) WHERE score >= {threshold} GROUP BY ALL),
b AS (SELECT rid, count(*) AS n_hits, arg_min(license, (-score, license, line)) AS license, max(score) AS score,
       arg_min(line, (-score, license, line)) AS line, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM g GROUP BY rid)
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, coalesce(n_hits, 0) AS n_hits,
  license, score, line, coalesce(licenses, '') AS licenses FROM d LEFT JOIN b USING (rid)"""
