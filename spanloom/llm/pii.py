"""Operator 8: personal data found by expanding anchors.

One Aho-Corasick pass over a text yields its anchors: at-signs, URL schemes, a plus
sign before a digit, pairs of digits (bare, dotted, or with a blank or hyphen
between), and words that announce an identifier.  From an anchor a small parser walks
outwards to the boundaries of what it announces and validates it.

Base kinds follow these patterns, leftmost and without overlap within a kind; a match
that fails validation is dropped and what it covered is not tried again:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)      each part at most 255
    card   [0-9]([\\x20-]?[0-9])+                       16 to 19 digits passing Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                 8 to 15 digits

Two kinds are added: `url_login`, the user part of scheme://user:password@host, and
`account`, the value after a cue such as token, password, iban or ssn and an `=` or
`:`.  They never change what the base kinds find.

Every parser stops where its last walk ended or shares that walk, so time is linear in
the text, whatever it holds; a text is never cut, and takes a few times its size.
Overlapping spans of different kinds are all reported; masking merges them.

Offsets count code points; ends are exclusive.  A null text counts as empty and has no
spans.  Rows are handled one by one: repeated rows and null ids pass through, an empty
table gives an empty result, further columns are not read by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url_login", "account")
#: words before a separator and a value that name an identifier or credential
CUES = ("account", "acct", "api_key", "apikey", "iban", "passport", "password", "passwd", "secret", "ssn", "token")
_DIGITS = "0123456789"
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + _DIGITS)
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_PHONE = frozenset(" ().-" + _DIGITS)
_DIGIT = frozenset(_DIGITS)
_VALUE = _ALNUM | frozenset("_+/=.-")
_SCHEMES = ("http://", "https://", "ftp://", "ssh://")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """Pattern -> (what it announces, its length)."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    for a in _DIGITS:
        found.add_word("+" + a, ("plus", 2))
        for b in _DIGITS:
            found.add_word(a + b, ("digits", 2))
            found.add_word(f"{a} {b}", ("digits", 3))
            found.add_word(f"{a}-{b}", ("digits", 3))
            found.add_word(f"{a}.{b}", ("dotted", 3))
    for scheme in _SCHEMES:
        found.add_word(scheme, ("scheme", len(scheme)))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = ord(x) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _run(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == "." and (to := _run(text, end + 1, _LABEL)) > end + 1:
        end, labels = to, labels + 1
    return (start, end) if labels > 1 else None


def _digit_run(text: str, at: int, floor: int) -> tuple[int, int]:
    """The run of digits around `at`, single blanks or hyphens between digits allowed."""
    start = at
    while start > floor:
        if text[start - 1] in _DIGIT:
            start -= 1
        elif start - 1 > floor and text[start - 1] in " -" and text[start - 2] in _DIGIT:
            start -= 2
        else:
            break
    end, n = at + 1, len(text)
    while end < n:
        if text[end] in _DIGIT:
            end += 1
        elif end + 1 < n and text[end] in " -" and text[end + 1] in _DIGIT:
            end += 2
        else:
            break
    return start, end


def _dotted(text: str, at: int, floor: int) -> tuple[int, int, int]:
    """The first four dotted numbers from the start of the number around `at`: start, end, parts."""
    start = at
    while start > floor and text[start - 1] in _DIGIT:
        start -= 1
    end, parts = _run(text, at, _DIGIT), 1
    while parts < 4 and end < len(text) and text[end] == "." and (to := _run(text, end + 1, _DIGIT)) > end + 1:
        end, parts = to, parts + 1
    return start, end, parts


def _phone(text: str, at: int) -> tuple[int, int] | None:
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGIT:
        end -= 1
    return (at, end) if end > at + 3 else None


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Validated spans of every kind, in order of their starts."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if not text:
        return found
    mail = ip = card = phone = url = account = 0  # where each kind's last try ended
    run_end = last_digit = -1  # of the value characters that were walked last
    for last, (what, size) in anchors().iter(text):
        at = last + 1 - size
        if what == "digits":
            if at >= card:
                start, card = _digit_run(text, at, card)
                digits = text[start:card].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append((start, card))
        elif what == "dotted":
            if at >= ip:
                start, end, parts = _dotted(text, at, ip)
                if parts == 4:
                    ip = end
                    if all(map(_small, text[start:end].split("."))):
                        found["ip"].append((start, end))
        elif what == "at":
            if at >= mail and (span := _email(text, at, mail)):
                mail = span[1]
                found["email"].append(span)
        elif what == "plus":
            if at >= phone and (span := _phone(text, at)):
                phone = span[1]
                if 8 <= sum(x in _DIGIT for x in text[at:phone]) <= 15:
                    found["phone"].append(span)
        elif what == "scheme":
            if at >= url:
                start = last + 1
                end = _run(text, start, _LOCAL | {":"})
                if ":" in text[start:end] and text[end : end + 1] == "@":
                    url = end
                    found["url_login"].append((start, end))
        elif at >= account and (at == 0 or text[at - 1] not in _ALNUM):
            start = last + 1
            while start < len(text) and text[start] in " =:'\"" and start - last <= 4:
                start += 1
            if start >= run_end:
                run_end = _run(text, start, _VALUE)
                last_digit = max((text.rfind(x, start, run_end) for x in _DIGITS), default=-1)
            if ("=" in text[last + 1 : start] or ":" in text[last + 1 : start]) and run_end - start >= 6 and last_digit >= start:
                account = run_end
                found["account"].append((start, run_end))
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in found[kind])


def mask(text: str | None, found: dict[str, list[tuple[int, int]]]) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlaps merge."""
    spans = sorted((a, b, kind) for kind, own in found.items() for a, b in own)
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_REPORT = "id {}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, masked string"


def _report(masked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                every = [find(x) for x in texts]
                arrays = [part.column("id"), *(pa.array([len(x[k]) for x in every], pa.int64()) for k in BASE_KINDS)]
                arrays.append(pa.array([hashlib.sha256(joined(x, BASE_KINDS).encode()).hexdigest() for x in every], pa.string()))
                arrays.append(pa.array([joined(x) for x in every], pa.string()))
                arrays.append(pa.array([mask(t, x) if masked else None for t, x in zip(texts, every)], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked"])

    return run


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masked: bool = True) -> DataFrame:
    """Counts, span lists and (unless `masked` is off) the masked text of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_report(masked), _REPORT.format(kind)).withColumnRenamed("id", id_col)


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.schema.get_field_index("text")
        for part in slices(batch):
            texts = pa.array([mask(x, find(x)) for x in part.column(k).to_pylist()], batch.schema.field(k).type)
            yield part.set_column(k, batch.schema.field(k), texts)


def mask_documents(docs: DataFrame) -> DataFrame:
    """All columns of `docs`, with personal data in `text` masked; every row stays."""
    return docs.mapInArrow(_masked, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), masked=False).drop("masked")
