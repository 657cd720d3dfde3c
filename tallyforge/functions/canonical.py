"""Digests of settings and keys as canonical JSON: keys in one order, values as they were written."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# The settings of a judge that its digest is of, and the parts of a key of reuse in order, with those left out when empty.
JUDGE_KEYS = ("model", "base_url", "temperature", "max_tokens", "output_format", "parallel", "extra_body")
REUSE_PARTS = (
    ("task", "task_sha256"), ("conversation", "conversation_sha256"), ("rubric", "rubric_sha256"), ("reference", "reference_sha256"), ("candidates", "candidates_sha256"),
    ("prompt_version", "prompt_version"), ("cmoa_version", "cmoa_version"), ("selection_rule", "selection_rule"), ("judge", "judge_sha256"),
    ("allow_tie", "allow_tie"), ("seed", "seed"), ("judge_seed", "judge_seed"),
)
LEFT_OUT_EMPTY = ("rubric", "reference")
ESCAPED = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029"}
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_SPACE = " \t\r\n"


def compact(text: str) -> str:
    """JSON text without the white space between its tokens and with the characters of ESCAPED as escapes; all else as written, numbers,
    escapes and the order of keys too."""
    out, at = [], 0
    for m in _STRING.finditer(text):
        out += [re.sub(r"[ \t\r\n]+", "", text[at : m.start()]), "".join(ESCAPED.get(c, c) for c in m[0])]
        at = m.end()
    return "".join([*out, re.sub(r"[ \t\r\n]+", "", text[at:])])


def members(text: str) -> Iterator[tuple[str, str]]:
    """Key and written value of every member of a JSON object; ValueError for any other text."""
    decoder = json.JSONDecoder()
    skip = lambda i: next((k for k in range(i, len(text)) if text[k] not in _SPACE), len(text))
    at = skip(0)
    if text[at : at + 1] != "{":
        raise ValueError("no JSON object")
    at = skip(at + 1)
    while text[at : at + 1] != "}":
        key, at = decoder.raw_decode(text, at)
        at = skip(at)
        if not isinstance(key, str) or text[at : at + 1] != ":":
            raise ValueError("no member")
        start = skip(at + 1)
        _, end = decoder.raw_decode(text, start)
        yield key, text[start:end]
        at = skip(end)
        if text[at : at + 1] == ",":
            at = skip(at + 1)
        elif text[at : at + 1] != "}":
            raise ValueError("no end")


def picked(text: str | None, keys: tuple[str, ...] = JUDGE_KEYS) -> str | None:
    """The members of a JSON object with these keys as canonical JSON, keys in order; of repeated keys the last. None for what is no object."""
    try:
        held = {k: v for k, v in members(text or "") if k in keys}
    except ValueError:
        return None
    return "{" + ",".join(f"{compact(json.dumps(k, ensure_ascii=False))}:{compact(held[k])}" for k in sorted(held)) + "}"


def settings_digest(text: Column, keys: tuple[str, ...] = JUDGE_KEYS) -> Column:
    """SC-17: SHA-256 of the named settings of a JSON object, nested values as they were written; null for what is no object."""

    @pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (p := picked(t, keys)) is None else hashlib.sha256(p.encode("utf-8", "surrogatepass")).hexdigest())

    return digest(text)


def json_string(c: Column) -> Column:
    """A string as a JSON token, with the characters of ESCAPED and control characters as escapes."""
    out = F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    for k in (11, 14, 15, *range(26, 32)):  # hexadecimal digits in lower case
        out = F.replace(out, F.lit(f"\\u{k:04X}"), F.lit(f"\\u{k:04x}"))
    for char, escape in ESCAPED.items():
        out = F.replace(out, F.lit(char), F.lit(escape))
    return out


def reuse_digest(parts: dict[str, Column]) -> Column:
    """JN-15: SHA-256 of a key's twelve parts as JSON in their order; null strings are empty, null numbers 0, null flags false."""
    written = []
    for part, name in REUSE_PARTS:
        c = parts[part]
        if part == "allow_tie":
            token = F.when(F.coalesce(c, F.lit(False)), "true").otherwise("false")
        elif part in ("seed", "judge_seed"):
            token = F.coalesce(c, F.lit(0)).cast("string")
        else:
            token = json_string(F.coalesce(c.cast("string"), F.lit("")))
        member = F.concat(F.lit(f'"{name}":'), token)
        written.append(F.when(F.coalesce(c.cast("string"), F.lit("")) != "", member) if part in LEFT_OUT_EMPTY else member)
    return F.sha2(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*written)), ","), F.lit("}")), 256)
