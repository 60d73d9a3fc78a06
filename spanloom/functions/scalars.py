"""Scalar functions on spans as column expressions: labels, formats, geometry, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MILLI, MICRO = 1_000_000_000, 1_000_000, 1_000
#: fixed values of the trace format, by number
KINDS = ("unspecified", "internal", "server", "client", "producer", "consumer")
STATUSES = ("unset", "ok", "error")
#: digests of different domains never agree; stores that must agree name the same one
DIGEST_DOMAIN = "spanloom:redaction:v1"


def idiv(a: Column, b) -> Column:
    """Whole quotient, towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _label(value: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.when((value >= 0) & (value < len(names)), value.cast("int") + 1))


def _number(label: Column, names: tuple[str, ...]) -> Column:
    """Position of a label; a number in range is itself; null for anything else."""
    at = F.array_position(F.array(*map(F.lit, names)), F.lower(F.trim(label)))
    digits = label.try_cast("int")
    return F.when(at > 0, (at - 1).cast("int")).when((digits >= 0) & (digits < len(names)), digits)


def kind_label(kind: Column) -> Column:
    return _label(kind, KINDS)


def parse_kind(label: Column) -> Column:
    return _number(label, KINDS)


def status_label(status: Column) -> Column:
    return _label(status, STATUSES)


def parse_status(label: Column) -> Column:
    return _number(label, STATUSES)


def attr(attributes: Column, key: str) -> Column:
    """The first attribute struct of a key, or null."""
    return F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))


def attr_typed(attributes: Column, key: str, value_type: str, sql_type: str) -> Column:
    """The value of an attribute if its tag is `value_type` and it parses, else null."""
    found = attr(attributes, key)
    return F.when(found["value_type"] == value_type, found["value"].try_cast(sql_type))


def has_attr(attributes: Column, key: str) -> Column:
    return F.coalesce(F.exists(attributes, lambda a: a["key"] == key), F.lit(False))


def format_duration(ns: Column) -> Column:
    """1.82s, 19ms, 404µs or 5ns: the largest unit that fits."""
    return (
        F.when(ns >= SECOND, F.format_string("%.2fs", ns.cast("double") / SECOND))
        .when(ns >= MILLI, F.concat(idiv(ns, MILLI).cast("string"), F.lit("ms")))
        .when(ns >= MICRO, F.concat(idiv(ns, MICRO).cast("string"), F.lit("µs")))
        .when(ns.isNotNull(), F.concat(ns.cast("string"), F.lit("ns")))
    )


def format_timestamp(ns: Column) -> Column:
    """UTC text with milliseconds; the session time zone must be UTC."""
    return F.concat(F.date_format(F.timestamp_micros(idiv(ns - F.pmod(ns, F.lit(MICRO)), MICRO)), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC"))


def human_age(created_ns: Column, now_ns: Column) -> Column:
    age = idiv(F.greatest(F.lit(0).cast("bigint"), now_ns - created_ns), SECOND)
    part = lambda n, unit: F.concat(idiv(age, n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(age < 60, part(1, "s")).when(age < 3600, part(60, "m")).when(age < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def clean_label(text: Column, most: int) -> Column:
    """Blanks collapsed, cut to `most` characters with an ellipsis (0: not cut)."""
    clean = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
    if most <= 0:
        return clean
    return F.when(F.char_length(clean) <= most, clean).otherwise(F.concat(F.left(clean, F.lit(most - 1)), F.lit("…")))


def signed_duration(ns: Column) -> Column:
    return F.when(ns > 0, F.concat(F.lit("+"), format_duration(ns))).when(ns < 0, F.concat(F.lit("-"), format_duration(-ns))).when(ns == 0, F.lit("0"))


def short_trace_id(trace_id: Column) -> Column:
    return F.left(trace_id, F.lit(8))


def bar_geometry(started: Column, ended: Column, root_started: Column, root_ended: Column, width: int) -> tuple[Column, Column]:
    """Offset and width of a bar on a timeline of `width` characters."""
    span = root_ended - root_started
    scale = F.lit(float(width)) / span.cast("double")
    raw = F.least(F.lit(width), F.greatest(F.lit(0), F.round((started - root_started).cast("double") * scale).cast("bigint")))
    wide = F.greatest(F.lit(1), F.round((ended - started).cast("double") * scale).cast("bigint"))
    over = raw + wide > width
    offset = F.when(over & (raw == width), F.lit(width - 1)).otherwise(raw)
    fit = F.when(over, F.greatest(F.lit(1), F.lit(width) - raw)).otherwise(wide)
    return F.when(span <= 0, F.lit(0)).otherwise(offset).cast("bigint"), F.when(span <= 0, F.lit(width)).otherwise(fit).cast("bigint")


def gap_min_ns(root_duration: Column, width: int) -> Column:
    """The least gap worth a character; 0 switches gaps off."""
    if width <= 0:
        return F.lit(0).cast("bigint")
    return F.when(root_duration <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), idiv(root_duration, width))).cast("bigint")


def stable_digest(value: Column, domain: str = DIGEST_DOMAIN) -> Column:
    raw = F.concat(F.lit(domain.encode() + b"\0"), value.cast("binary"))
    return F.concat(F.lit("sha256:v1:"), F.sha2(raw, 256))


def truncate_utf8(value: Column, most: int | Column) -> Column:
    """At most `most` bytes, ending in an ellipsis where cut, never inside a character."""
    most = F.lit(most) if isinstance(most, int) else most
    raw = value.cast("binary")
    heads = [F.substring(raw, F.lit(1), F.greatest(most - 3 - k, F.lit(0))).cast("string") for k in range(4)]
    head = F.coalesce(*[F.when(F.is_valid_utf8(h), h) for h in heads], F.lit(""))
    cut = F.when(most <= 3, F.repeat(F.lit("."), most)).otherwise(F.concat(head, F.lit("…")))
    return F.when(F.octet_length(value) <= most, value).otherwise(cut)


def safe_path(path: Column, key: Column) -> Column:
    """A field's path that ends in its quoted key, with a short digest for the key."""
    short = F.substring(stable_digest(key), len("sha256:v1:") + 1, 12)
    head = F.char_length(path) - F.char_length(key) - 4
    return F.when(key.isNull(), path).otherwise(F.concat(F.substring(path, F.lit(1), head), F.lit('["<field:'), short, F.lit('>"]')))


def safe_metadata(value: Column) -> Column:
    """Free text for reports: no control characters, at most 128 bytes, `unknown` if empty."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("unknown")).otherwise(truncate_utf8(F.regexp_replace(value, r"[\x00-\x1f\x7f]", ""), F.lit(128)))


def parse_unit(text: Column) -> Column:
    """A trimmed non-negative 32-bit integer, else null."""
    found = F.trim(text).try_cast("int")
    return F.when(found >= 0, found)


def parse_unblocks(text: Column) -> tuple[Column, Column]:
    """Distinct targets of a comma-separated list, and the tokens that are none."""
    tokens = F.transform(F.split(text, ","), lambda x: F.trim(x))
    good = F.array_distinct(F.filter(F.transform(tokens, parse_unit), lambda x: x.isNotNull()))
    return good, F.filter(tokens, lambda x: parse_unit(x).isNull())


def package_label(package: Column, module: str) -> Column:
    """The package without its own module's prefix."""
    return F.when(F.startswith(package, F.lit(module + "/")), F.substr(package, F.lit(len(module) + 2))).otherwise(package)


def event_time_ns(text: Column) -> Column:
    """RFC 3339 text to nanoseconds; 0 where it does not parse."""
    digits = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})", 1), 9, "0")
    micros = F.unix_micros(F.try_to_timestamp(text))
    return F.coalesce(micros * 1000 + F.substring(digits, 7, 3).cast("bigint"), F.lit(0))


def seconds_to_ns(seconds: Column) -> Column:
    """Seconds to whole nanoseconds: none below zero or for NaN, at most 9e9 seconds."""
    return F.when((seconds > 0) & ~F.isnan(seconds), (F.least(seconds, F.lit(9e9)) * 1e9).cast("bigint")).otherwise(F.lit(0)).cast("bigint")


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def unit_name(name: Column, version: Column, target: Column) -> Column:
    kind = F.trim(F.coalesce(target, F.lit("")))
    return F.concat(name, F.lit(" v"), version, F.when(kind != "", F.concat(F.lit(" ("), kind, F.lit(")"))).otherwise(F.lit("")))


def suite_name(name: Column) -> Column:
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", F.lit("(suite)")).otherwise(name)
