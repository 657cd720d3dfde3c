"""Heads of documents: a small grammar of nested maps, lists, quoted, folded and literal scalars, read into JSON values and written back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

Value = dict | list | str | int | float | bool | None
PLAIN = {"true": True, "false": False, "null": None, "~": None, "": None, "{}": {}, "[]": []}
NUMBER = re.compile(r"[-+]?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")
KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s'"#\[{>|&*!%@`,-][^:#]*?|-[^\s:][^:]*?)\s*:(?=\s|$)\s*(.*)""")


class Malformed(ValueError):
    """A head that does not follow the grammar, with its line."""


def scalar(text: str) -> Value:
    """A value on one line: quoted strings, numbers, words of PLAIN, lists in brackets; anything else is a string as it stands."""
    text = text.strip()
    if text.startswith('"'):
        return json.loads(text)
    if text.startswith("'"):
        if not re.fullmatch(r"'(?:[^']|'')*'", text):
            raise Malformed(text)
        return text[1:-1].replace("''", "'")
    if text in PLAIN:
        held = PLAIN[text]
        return type(held)() if isinstance(held, (dict, list)) else held
    if text.startswith("[") and text.endswith("]"):
        parts = re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]]+)\s*(?:,|$)""", text[1:-1])
        return [scalar(p) for p in parts]
    if NUMBER.fullmatch(text):
        return json.loads(text.lstrip("+"))
    if text[:1] in ("{", "&", "*", "!", "%", "@", "`"):
        raise Malformed(text)
    return text


class Reader:
    def __init__(self, text: str) -> None:
        self.lines, self.at = text.split("\n"), 0

    def peek(self) -> tuple[int, str] | None:
        """Indent and text of the next line that is neither blank nor a comment."""
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or self.lines[self.at].lstrip().startswith("#")):
            self.at += 1
        if self.at == len(self.lines):
            return None
        line = self.lines[self.at]
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise Malformed(f"line {self.at + 1}: a tab in its indent")
        return len(line) - len(line.lstrip(" ")), line.strip()

    def block(self, least: int) -> Value:
        """The map or list whose lines have an indent of at least `least`; None if there is none."""
        head = self.peek()
        if head is None or head[0] < least:
            return None
        return self.items(head[0]) if head[1] == "-" or head[1].startswith("- ") else self.members(head[0])

    def members(self, indent: int) -> dict:
        out: dict[str, Value] = {}
        while (head := self.peek()) and head[0] == indent and not head[1].startswith("- "):
            m = KEY.fullmatch(head[1])
            if not m:
                raise Malformed(f"line {self.at + 1}: {head[1]}")
            key = scalar(m[1]) if m[1][0] in "\"'" else m[1]
            if key in out:
                raise Malformed(f"line {self.at + 1}: {key} again")
            self.at += 1
            out[key] = self.value(m[2], indent)
        if head and head[0] > indent:
            raise Malformed(f"line {self.at + 1}: an indent too deep")
        return out

    def items(self, indent: int) -> list:
        out = []
        while (head := self.peek()) and head[0] == indent and (head[1] == "-" or head[1].startswith("- ")):
            rest = head[1][1:].strip()
            if KEY.fullmatch(rest) and rest[:1] != "[":  # a map whose first member stands beside the dash
                self.lines[self.at] = " " * (indent + 2) + rest
                out.append(self.members(indent + 2))
            else:
                self.at += 1
                out.append(self.value(rest, indent))
        if head and head[0] > indent:
            raise Malformed(f"line {self.at + 1}: an indent too deep")
        return out

    def value(self, text: str, indent: int) -> Value:
        if not text:
            nested = self.peek()  # a list may stand at its key's own indent
            return self.block(indent if nested and nested[1].startswith("-") and nested[0] == indent else indent + 1)
        if text[0] in ">|" and re.fullmatch(r"[>|][-+]?", text):
            return self.folded(text, indent)
        return scalar(text)

    def folded(self, mark: str, indent: int) -> str:
        """The deeper lines that follow: joined by spaces (>), blank lines as line feeds, or kept (|); a last line feed unless the mark has a dash."""
        held: list[str] = []
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or len(self.lines[self.at]) - len(self.lines[self.at].lstrip(" ")) > indent):
            held.append(self.lines[self.at])
            self.at += 1
        while held and not held[-1].strip():
            held.pop()
        depth = min((len(x) - len(x.lstrip(" ")) for x in held if x.strip()), default=0)
        held = [x[depth:] for x in held]
        text = "\n".join(held) if mark[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(held)).replace("\n\n", "\n")
        return text + ("" if mark.endswith("-") or not held else "\n")


def parse(text: str) -> Value:
    """A head's value; Malformed for what the grammar does not know."""
    reader = Reader(text)
    try:
        found = reader.block(0)
    except json.JSONDecodeError as error:
        raise Malformed(str(error)) from error
    if reader.peek() is not None:
        raise Malformed(f"line {reader.at + 1}: {reader.peek()[1]}")
    return {} if found is None else found


def written(value: Value, indent: int = 0) -> Iterator[str]:
    """The lines of a map or list, in a form that parse() reads as the same value."""
    pad = " " * indent
    for key, held in value.items() if isinstance(value, dict) else ((None, v) for v in value):
        start = f"{pad}- " if key is None else f"{pad}{key if re.fullmatch(r'[A-Za-z_][A-Za-z0-9_-]*', key) else json.dumps(key)}: "
        if isinstance(held, (dict, list)) and held:
            yield start.rstrip()
            yield from written(held, indent + 2)
        else:
            yield start + ("{}" if held == {} and isinstance(held, dict) else "[]" if held == [] else plain(held))


def plain(value: str | float | bool | None) -> str:
    """A scalar; strings stand bare only where that is read as the same string."""
    if isinstance(value, str) and re.fullmatch(r"[A-Za-z][A-Za-z0-9 _./@-]*(?<! )", value) and value not in PLAIN:
        return value
    return json.dumps(value, ensure_ascii=False)


def render(value: dict | list) -> str:
    return "".join(f"{line}\n" for line in written(value))


def head_json(text: Column) -> Column:
    """A head as JSON with keys in order; null for what the grammar does not know."""

    @pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(parse(t), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            except Malformed:
                return None

        return texts.map(one)

    return read(text)


def head_text(head: Column) -> Column:
    """A head from JSON of a map, as head_json() reads it."""

    @pandas_udf("string")
    def write(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else render(json.loads(t)))

    return write(head)
