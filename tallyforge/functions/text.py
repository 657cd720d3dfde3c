"""Text expressions: slugs, tidied errors, request failures, labels, spans and identifiers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(s: Column) -> Column:
    """SC-01."""
    return F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-"))


# The characters that count as white space in error texts.
WHITE_SPACE = "[\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


def tidy(s: Column, most: int = 160) -> Column:
    """SC-02: white space collapsed and trimmed; over `most` bytes of UTF-8 cut there, trimmed and marked. A letter that the cut parts becomes U+FFFD."""
    flat = F.btrim(F.regexp_replace(s, WHITE_SPACE, " "), F.lit(" "))
    head = F.make_valid_utf8(F.substring(flat.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(flat) > most, F.concat(F.btrim(head, F.lit(" ")), F.lit(" […]"))).otherwise(flat)


# How an error tells its status, and the texts of a refusal over the size of the prompt.
HTTP_STATUS = r"HTTP (\d{3})"
CONTEXT_OVERFLOW = "(?i)n_ctx|context length|context_length|context window|maximum context|too many tokens|max_tokens|prompt is too long|exceeds"


def http_status(s: Column) -> Column:
    """SC-04: the status in an error text; 0 if there is none, as in transport errors."""
    return F.coalesce(F.nullif(F.regexp_extract(s, HTTP_STATUS, 1), F.lit("")).cast("int"), F.lit(0))


def http_reason(s: Column) -> Column:
    """SC-04: why a request was refused (4xx), null for other errors."""
    code = http_status(s)
    return (
        F.when(~code.between(400, 499), None).when(s.rlike(CONTEXT_OVERFLOW), "context-length").when(code == 413, "payload-too-large")
        .when(code == 429, "rate-limited").when(code.isin(401, 403), "not-authorised").otherwise(F.concat(F.lit("http-"), code.cast("string")))
    )


# How git apply names a file whose hunks do not fit.
FAILED_FILE = r"(?m)^error: ([^:\n]+): patch does not apply$"


def failed_files(apply_error: Column, diff_files: Column) -> Column:
    """SC-03: the files that an apply failure names, in order and once each; those that the diff touches where it names none."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(F.coalesce(apply_error, F.lit("")), F.lit(FAILED_FILE), F.lit(1))
    return F.array_sort(F.array_distinct(F.when(F.size(found) > 0, found).otherwise(F.coalesce(diff_files, none))))


# Exit codes by which a harness refuses its settings, and the classes of failed calls.
REFUSED_CODES = [2, 3]


def error_class(failed: Column, cancelled: Column, exit_code: Column, verifier_error: Column) -> Column:
    """PRJ-12: how a call ended: none, timeout, infra, harness_crash or verifier_error. Only none counts as an answer.

    A call that was cancelled, or died of a signal (code -1), timed out, whatever its message says; the codes of a refusal are a
    crash of the harness; other failures are infrastructure. A call that did not fail has a verifier that could not run, or no error."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~yes(failed), F.when(yes(verifier_error), "verifier_error").otherwise("none")).when(yes(cancelled), "timeout")
        .when(exit_code.isin(REFUSED_CODES), "harness_crash").when(exit_code == -1, "timeout").otherwise("infra")
    )


def fixed(x: Column, places: int) -> Column:
    """A double with that many places, rounded by its exact binary value as C's printf does; format_string rounds its shortest decimal."""
    shown = F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * places))
    half = float(f"5e-{places + 1}")  # under the last place DecimalFormat takes each half for a tie
    up = (F.abs(x) >= half) if Decimal(half) > Decimal(f"5e-{places + 1}") else (F.abs(x) > half)
    least = F.concat(F.when(x < 0, "-").otherwise(""), F.when(up, "0." + "0" * (places - 1) + "1").otherwise("0." + "0" * places))
    return F.when((x != 0) & (F.abs(x) < float(f"1e-{places}")), least).otherwise(shown)


def number(x: Column, places: int = 4) -> Column:
    """SC-06: a number with at most so many decimals and at least one; 0.0 for zero."""
    text = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", x.cast("double")), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(x == 0, "0.0").when(F.contains(text, F.lit(".")), text).otherwise(F.concat(text, F.lit(".0")))


def label(s: Column) -> Column:
    """SC-13: lower case, other characters to dashes, no dash or underscore first, 64 at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9_-]", "-"), "^[-_]+", ""), 1, 64)


def span(values: Column) -> Column:
    """SC-05: 'low-high' of an array of whole numbers, or the one number; an array with anything else in it is listed."""
    numbers = F.transform(values, lambda v: v.cast("string").try_cast("long"))
    lo, hi = F.array_min(numbers).cast("string"), F.array_max(numbers).cast("string")
    whole = (F.size(values) > 0) & F.forall(numbers, lambda n: n.isNotNull())
    return F.when(whole & (lo == hi), lo).when(whole, F.concat(lo, F.lit("-"), hi)).otherwise(listed(values))


def capped(values: Column, most: int = 4) -> Column:
    """OR-04: the first of an array, and how many more as its last element."""
    more = F.size(values) - most
    rest = F.concat(F.lit("and "), more.cast("string"), F.lit(" more"))
    head = F.transform(F.slice(values, 1, most), lambda v: v.cast("string"))
    return F.when(more > 0, F.array_append(head, rest)).otherwise(head)


def listed(values: Column, most: int = 4) -> Column:
    """OR-04: the first names and how many more; 'unknown' for none."""
    return F.when(F.size(values) > 0, F.array_join(capped(values, most), ", ")).otherwise("unknown")


def named(noun: str, values: Column, most: int = 4) -> Column:
    """SC-05: names after their noun, in the plural where there are several."""
    many = F.concat(F.lit(f"{noun}s "), F.array_join(capped(values, most), ", "))
    return F.when(F.size(values) == 0, f"an unnamed {noun}").when(F.size(values) == 1, F.concat(F.lit(f"{noun} "), values[0].cast("string"))).otherwise(many)


# The shapes of identifiers.
RUN_SHAPE = r"^run/(he-\d{4})@(\d{4}-\d{2}-\d{2})-([a-z0-9.]+(?:-[a-z0-9.]+)*)-(in|out)(?:-(\d+))?$"
VERIFIER_SHAPE = r"^verifier/([a-z0-9][a-z0-9-]{0,63})@(\d{4}-\d{2}-\d{2})(?:-(\d+))?$"
CALIBRATION_SHAPE = r"^calibration/([a-z0-9.]+(?:-[a-z0-9.]+)*)@(\d{4}-\d{2}-\d{2})(?:-(\d+))?$"
EDIT_SHAPE, PATTERN_SHAPE = r"^he-(\d{4})$", r"^fp/([a-z0-9-]+)$"
TASK_SHAPE, TRACE_SHAPE = r"^[a-z0-9][a-z0-9-]{0,63}$", r"^[0-9]{8}T[0-9]{6}Z-[0-9a-f]{8}$"


def _id_parts(s: Column, shape: str, **places: int) -> Column:
    """The named groups of an identifier, day as a date and seq as a number; null where it has not that shape or no such day."""
    part = lambda name: F.nullif(F.regexp_extract(s, shape, places[name]), F.lit(""))
    typed = {"day": lambda c: c.try_cast("date"), "seq": lambda c: c.try_cast("int")}
    fields = F.struct(*(typed.get(name, lambda c: c)(part(name)).alias(name) for name in places))
    fine = s.rlike(shape) & (fields["day"].isNotNull() if "day" in places else F.lit(True))
    return F.when(fine, fields)


def run_id_parts(s: Column) -> Column:
    """SC-12: edit, day, model, side and sequence of a run's identifier."""
    return _id_parts(s, RUN_SHAPE, edit=1, day=2, model=3, side=4, seq=5)


def verifier_id_parts(s: Column) -> Column:
    """SC-12: task, day and sequence of a verifier's identifier."""
    return _id_parts(s, VERIFIER_SHAPE, task=1, day=2, seq=3)


def calibration_id_parts(s: Column) -> Column:
    """SC-12: judge, day and sequence of a calibration's identifier."""
    return _id_parts(s, CALIBRATION_SHAPE, judge=1, day=2, seq=3)


def edit_number(s: Column) -> Column:
    """SC-12: the number of an edit's identifier; null where it is not one."""
    return F.nullif(F.regexp_extract(s, EDIT_SHAPE, 1), F.lit("")).cast("int")


def pattern_slug(s: Column) -> Column:
    """SC-12: the slug of a pattern's identifier; null where it is not one."""
    return F.nullif(F.regexp_extract(s, PATTERN_SHAPE, 1), F.lit(""))


def document_id(kind: str, name: Column, day: Column, seq: Column) -> Column:
    """SC-12: the identifier of a verifier or a calibration; a sequence number is shown from 2 on."""
    tail = F.when(F.coalesce(seq, F.lit(0)) > 1, F.concat(F.lit("-"), seq.cast("string"))).otherwise("")
    return F.concat(F.lit(f"{kind}/"), name, F.lit("@"), F.date_format(day, "yyyy-MM-dd"), tail)


def scrub(s: Column, bases: list[str], home: str = "") -> Column:
    """SC-11: a text without the bases (absolute folders) before its paths, and ~ for the home folder; the root is neither."""
    for base in (b.rstrip("/") for b in bases):
        s = F.replace(s, F.lit(f"{base}/"), F.lit("")) if base else s
    return F.replace(s, F.lit(home.rstrip("/")), F.lit("~")) if home.rstrip("/") else s


def record_path(path: Column, bases: list[str]) -> Column:
    """SC-11: a clean absolute path relative to the first base that it lies under, else its last name; never absolute."""
    out = F.when(path == "", "")
    for base in (b.rstrip("/") for b in bases if b):
        out = out.when(path == (base or "/"), ".").when(path.startswith(f"{base}/"), F.substring(path, F.lit(len(base) + 2), F.length(path)))
    return out.otherwise(F.regexp_extract(path, "([^/]+)/*$", 1))


def fnv_seed(task: Column, repeat: Column) -> Column:
    """SC-08: FNV-1a of 64 bits over the task's UTF-8 bytes, a zero byte and the repeat's decimal digits, without the top bit.

    The hash is kept as two halves of 32 bits, so no product overflows: the prime is 2^40 + 435."""
    coded = F.concat(F.hex(F.encode(task, "utf-8")), F.lit("00"), F.hex(F.encode(repeat.cast("string"), "utf-8")))
    places = F.sequence(F.lit(1), F.length(coded) - 1, F.lit(2))
    octets = F.transform(places, lambda i: F.conv(F.substr(coded, i, F.lit(2)), 16, 10).cast("long"))
    half = F.lit(0xFFFFFFFF)

    def step(h: Column, octet: Column) -> Column:
        lo = h["lo"].bitwiseXOR(octet)
        low = lo * 435
        high = h["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(lo, 8)
        return F.struct(high.bitwiseAND(half).alias("hi"), low.bitwiseAND(half).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).alias("hi"), F.lit(0x84222325).alias("lo"))
    return F.aggregate(octets, start, step, lambda h: F.shiftleft(h["hi"].bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(h["lo"]))


def flatten_conversation(turns: Column) -> Column:
    """SC-14: turns (array of struct turn, role, text) as one text with role marks, in turn order."""
    ordered = F.array_sort(turns, lambda a, b: F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0))
    return F.array_join(F.transform(ordered, lambda t: F.concat(F.lit("["), t["role"], F.lit("] "), t["text"])), "\n")


def tree_digest(path: Column, sha: Column) -> Column:
    """AG-45, an aggregate: SHA-256 over the sorted 'path newline sha newline' of a tree's files."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(path, F.lit("\n"), sha, F.lit("\n")))), ""), 256)


def subset_of(values: Column, allowed: list[str]) -> Column:
    """ST-04: false where the list is absent, true where it is empty."""
    return F.coalesce(F.size(F.array_except(values, F.array(*map(F.lit, allowed)))) == 0, F.lit(False))


def component(path: Column) -> Column:
    """PRJ-14: the surface that a harness path belongs to; 'refused' for paths that are not clean or have no place."""
    unclean = path.startswith("/") | path.contains("\\") | path.rlike(r"(^|/)(\.{0,2})(/|$)")
    return (
        F.when(unclean, "refused").when(path == "system-prompt.md", "system-prompt").when(path.rlike(r"^memory/[A-Za-z0-9][A-Za-z0-9._-]*\.md$"), "memory")
        .when(path.rlike(r"^skills/[a-z0-9][a-z0-9._-]{0,63}/SKILL\.md$"), "skill").otherwise("refused")
    )


def subset_digest(fields: dict[str, Column]) -> Column:
    """SC-17: SHA-256 of the named fields as JSON, keys in order, absent fields left out."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)
