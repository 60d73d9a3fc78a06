"""Readers of trace data: exported requests, trace documents, marks, and build and test reports.

Every reader is a plan over `spark.read` (or `readStream` where noted); no file is
opened outside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import scalars as S
from spanloom.sources.shared import materialize

_VALUE = "struct<stringValue:string,intValue:string,boolValue:boolean,doubleValue:double,bytesValue:string,arrayValue:string,kvlistValue:string>"
_KV = f"array<struct<key:string,value:{_VALUE}>>"
OTLP = f"""resourceSpans array<struct<resource:struct<attributes:{_KV}>,scopeSpans:array<struct<spans:array<struct<
  traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KV},
  links:array<struct<traceId:string,spanId:string,traceState:string,attributes:{_KV},droppedAttributesCount:bigint,flags:bigint>>,
  droppedAttributesCount:bigint,droppedLinksCount:bigint,status:struct<code:string>>>>>>>"""
ATTRIBUTES = "array<struct<key:string,value_type:string,value:string>>"
LINKS = f"array<struct<trace_id:string,span_id:string,trace_state:string,attributes:{ATTRIBUTES},dropped_attributes_count:bigint,flags:bigint>>"
#: longest line that line-based readers take, in bytes
MAX_LINE = 1 << 20


def go_double(value: Column) -> Column:
    """A double as the shortest text without a needless fraction: 1, 0.5, 1e+06."""
    text = value.cast("string")
    plain = F.regexp_replace(text, r"\.0$", "")
    exp = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(\d)$", "e+0$1"), r"E-(\d)$", "e-0$1")
    exp = F.regexp_replace(F.regexp_replace(exp, r"E-(\d\d)", "e-$1"), r"E(\d\d)", "e+$1")
    return F.when(text.contains("E"), exp).otherwise(plain)


def _attributes(column: Column) -> Column:
    def one(kv: Column) -> Column:
        v = kv["value"]
        kind = F.when(v["intValue"].isNotNull(), "int").when(v["boolValue"].isNotNull(), "bool").when(v["doubleValue"].isNotNull(), "float").when(v["bytesValue"].isNotNull(), "bytes").otherwise("str")
        text = F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), go_double(v["doubleValue"]), F.lower(F.hex(F.unbase64(v["bytesValue"]))), v["arrayValue"], v["kvlistValue"], F.lit(""))
        return F.struct(kv["key"].alias("key"), kind.alias("value_type"), text.alias("value"))

    return F.coalesce(F.transform(column, one).cast(ATTRIBUTES), F.array().cast(ATTRIBUTES))


def _enum(text: Column, names: tuple[str, ...], prefix: str) -> Column:
    known = F.array_position(F.array(*(F.lit(prefix + x.upper()) for x in names)), text)
    return F.coalesce(F.when(known > 0, (known - 1).cast("int")), text.try_cast("int"), F.lit(0))


def otlp_spans(requests: DataFrame, column: str = "value", id_encoding: str = "base64") -> DataFrame:
    """Spans of exported requests, one JSON document a row; also works on streams.

    Ids are base64 (or hex) text and come out as lower-case hex, 64-bit numbers are JSON
    strings, a missing start is 0, an absent parent null.  `ord` is the position within
    the request.
    """
    if id_encoding == "base64":
        hexed = lambda c: F.when(c != "", F.lower(F.hex(F.unbase64(c))))
    elif id_encoding == "hex":
        hexed = lambda c: F.when(c != "", F.lower(c))
    else:
        raise ValueError(f"unknown id encoding {id_encoding!r}")
    doc = requests.select(F.from_json(column, OTLP).alias("d"))
    res = doc.select(F.posexplode("d.resourceSpans").alias("i", "r"))
    label = _attributes(F.col("r.resource.attributes"))
    scope = res.select("i", F.coalesce(S.attr(label, "service.name")["value"], F.lit("")).alias("service"), F.posexplode("r.scopeSpans").alias("j", "s"))
    rows = scope.select("i", "j", "service", F.posexplode("s.spans").alias("k", "s"))
    ns = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0).cast("bigint"))
    link = lambda x: F.struct(hexed(x["traceId"]).alias("trace_id"), hexed(x["spanId"]).alias("span_id"), F.coalesce(x["traceState"], F.lit("")).alias("trace_state"), _attributes(x["attributes"]).alias("attributes"), F.coalesce(x["droppedAttributesCount"], F.lit(0)).alias("dropped_attributes_count"), F.coalesce(x["flags"], F.lit(0)).alias("flags"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return rows.select(
        hexed(F.col("s.traceId")).alias("trace_id"), hexed(F.col("s.spanId")).alias("span_id"), hexed(F.col("s.parentSpanId")).alias("parent_span_id"), F.coalesce("s.name", F.lit("")).alias("name"),
        _enum(F.col("s.kind"), S.KINDS, "SPAN_KIND_").alias("kind"), _enum(F.col("s.status.code"), S.STATUSES, "STATUS_CODE_").alias("status"), ns("s.startTimeUnixNano").alias("started_ns"), ns("s.endTimeUnixNano").alias("ended_ns"),
        (ns("s.endTimeUnixNano") - ns("s.startTimeUnixNano")).alias("duration_ns"), ((F.col("i") * 1_000_000 + F.col("j")) * 1_000_000 + F.col("k")).cast("bigint").alias("ord"),
        _attributes(F.col("s.attributes")).alias("attributes"), F.coalesce(F.transform("s.links", link).cast(LINKS), F.array().cast(LINKS)).alias("links"), zero("s.droppedAttributesCount").alias("dropped_attributes_count"), zero("s.droppedLinksCount").alias("dropped_links_count"), "service",
    )


def read_otlp_json(spark: SparkSession, path: str, id_encoding: str = "base64", whole: bool = True) -> DataFrame:
    """Spans of files that hold one request each (`whole`) or one request a line."""
    return otlp_spans(spark.read.text(path, wholetext=whole), id_encoding=id_encoding)


def trace_labels(spans: DataFrame) -> DataFrame:
    """(trace_id, run_label): service of the first span and root name, joined by a dot; one if equal or empty."""
    first = F.struct(F.col("parent_span_id").isNotNull(), "ord")
    found = spans.groupBy("trace_id").agg(F.min_by("service", "ord").alias("service"), F.min_by("name", first).alias("root"))
    both = F.when((F.col("service") == "") | (F.col("service") == F.col("root")), F.col("root")).when(F.col("root") == "", F.col("service")).otherwise(F.concat("service", F.lit(" · "), "root"))
    return found.select("trace_id", both.alias("run_label"))


TRACE = f"""trace_id string, run_label string, source string, root_name string, started_ns bigint, ended_ns bigint, duration_ns bigint, span_count bigint,
  spans array<struct<span_id:string,trace_id:string,parent_span_id:string,name:string,kind:string,status:string,started_ns:bigint,ended_ns:bigint,duration_ns:bigint,attributes:{ATTRIBUTES},links:{LINKS},dropped_attributes_count:bigint,dropped_links_count:bigint>>"""


_STRING, _WHOLE, _EITHER, _LIST = "STRING", "BIGINT", "STRING|BIGINT", "ARRAY"
_ATTRIBUTE = {"key": _STRING, "value_type": _STRING, "value": _STRING}
#: fields of stored-trace documents, by level, and what they may hold besides null
FIELDS = {
    "trace": {
        "trace_id": _STRING, "run_label": _STRING, "source": _STRING, "root_name": _STRING, "started_ns": _WHOLE, "ended_ns": _WHOLE, "duration_ns": _WHOLE, "span_count": _WHOLE, "spans": _LIST,
    },
    "span": {
        "span_id": _STRING, "trace_id": _STRING, "parent_span_id": _STRING, "name": _STRING, "kind": _EITHER, "status": _EITHER, "started_ns": _WHOLE, "ended_ns": _WHOLE, "duration_ns": _WHOLE,
        "attributes": _LIST, "links": _LIST, "dropped_attributes_count": _WHOLE, "dropped_links_count": _WHOLE,
    },
    "attribute": _ATTRIBUTE,
    "link": {"trace_id": _STRING, "span_id": _STRING, "trace_state": _STRING, "attributes": _LIST, "dropped_attributes_count": _WHOLE, "flags": _WHOLE},
    "link_attribute": _ATTRIBUTE,
}
#: bytes of an imported document at most
MOST_IMPORTED = 16 << 20


def _spans_of(docs: DataFrame) -> DataFrame:
    rows = docs.select("trace_id", F.posexplode("spans").alias("ord", "s"))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c.split(".")[-1])
    kind, status = (F.coalesce(parse(F.col(c)), F.when(F.col(c).isNull(), F.lit(0))) for parse, c in ((S.parse_kind, "s.kind"), (S.parse_status, "s.status")))
    return rows.select(
        "trace_id", "s.span_id", blank("s.parent_span_id").alias("parent_span_id"), "s.name", kind.alias("kind"), status.alias("status"), "s.started_ns", "s.ended_ns", "s.duration_ns", (F.col("ord") + 1).cast("bigint").alias("ord"),
        F.coalesce("s.attributes", F.array().cast(ATTRIBUTES)).alias("attributes"), F.coalesce("s.links", F.array().cast(LINKS)).alias("links"), count("s.dropped_attributes_count"), count("s.dropped_links_count"),
    )


def _problems(parts: DataFrame, level: str) -> DataFrame:
    """What is wrong with the objects `v` of a level: (document, reason, field)."""
    known = FIELDS[level]
    is_object = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    keys = F.transform(F.coalesce(F.json_object_keys(F.to_json("v")), F.array().cast("array<string>")), lambda k: F.lower(k))
    found = [F.transform(F.array_except(keys, F.array(*map(F.lit, known))), lambda k: F.struct(F.lit("unknown_field").alias("reason"), F.concat(F.lit(f"{level}."), k).alias("field")))]
    for name, kinds in known.items():
        kind = F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
        good = kind.isNull() | (kind == "VOID") | (F.startswith(kind, F.lit("ARRAY")) if kinds == _LIST else kind.isin(*kinds.split("|")))
        at = F.lit(f"{level}.{name}")
        found.append(F.when(~good, F.array(F.struct(F.lit("wrong_type").alias("reason"), at.alias("field")))))
        if kinds == _EITHER:
            text = F.try_variant_get("v", f"$.{name}", "string")
            parsed = (S.parse_kind if name == "kind" else S.parse_status)(text)
            found.append(F.when(good & text.isNotNull() & parsed.isNull(), F.array(F.struct(F.lit("unknown_label").alias("reason"), at.alias("field")))))
    every = F.flatten(F.array_compact(F.array(*found)))
    no_object = F.array(F.struct(F.lit("wrong_type").alias("reason"), F.lit(level).alias("field")))
    return parts.select("document", F.explode(F.when(is_object, every).otherwise(no_object)).alias("p")).select("document", "p.*")


def import_traces(docs: DataFrame, column: str = "value", name: str = "document", most_bytes: int = MOST_IMPORTED) -> tuple[DataFrame, DataFrame]:
    """Spans of stored-trace documents (name, value), and the documents that were refused.

    A document must be one JSON value of known fields of the right types; labels of kind
    and status may be numbers.  Otherwise nothing of it is taken, and `refused` has a row
    (document, reason, field) for everything that is wrong: too_large, malformed_json,
    trailing_value, wrong_type, unknown_field, unknown_label.
    """
    rows = docs.select(F.col(name).alias("document"), F.col(column).alias("value"))
    fits = F.octet_length("value") <= most_bytes
    # the parser stops behind the first value: only one value alone fits both an array and an object
    alone = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))
    single = (F.size(F.try_variant_get(alone, "$", "array<variant>")) == 1) & F.try_parse_json(F.concat(F.lit('{"x":'), "value", F.lit("}"))).isNotNull()
    rows = rows.withColumn("v", F.when(fits & F.coalesce(single, F.lit(False)), F.try_parse_json("value")))
    first = F.from_json("value", "trace_id string, spans array<string>")
    reason = F.when(~fits, "too_large").when(F.col("v").isNull() & first["trace_id"].isNotNull(), "trailing_value").when(F.col("v").isNull(), "malformed_json")
    whole = rows.where(F.col("v").isNull()).select("document", reason.alias("reason"), F.lit(None).cast("string").alias("field"))
    read = rows.where(F.col("v").isNotNull())

    def inner(parts: DataFrame, field: str) -> DataFrame:
        return parts.select("document", F.explode(F.try_variant_get("v", f"$.{field}", "array<variant>")).alias("v"))

    spans = inner(read, "spans")
    links = inner(spans, "links")
    levels = {"trace": read, "span": spans, "attribute": inner(spans, "attributes"), "link": links, "link_attribute": inner(links, "attributes")}
    refused = whole
    for level, parts in levels.items():
        refused = refused.unionByName(_problems(parts, level))
    refused = materialize(refused.distinct(), "refused")
    kept = rows.join(refused.select("document").distinct(), "document", "left_anti")
    return _spans_of(kept.select(F.from_json("value", TRACE).alias("d")).select("d.*")), refused


def read_trace_json(spark: SparkSession, path: str) -> DataFrame:
    """Spans of stored-trace documents, a file each; enums may be labels or numbers, a document that is refused fails the read."""
    spans, refused = import_traces(read_pages(spark, path), name="run_id")
    if (bad := refused.orderBy("document", "reason", "field").first()) is not None:
        raise ValueError(f"document {bad.document!r} refused: {bad.reason} {bad.field or ''}".rstrip())
    return spans


def mark_rows(lines: DataFrame) -> DataFrame:
    """Marks from lines of JSON (value, run_id, ord); blank, malformed and oversize lines are skipped."""
    found = lines.where((F.octet_length("value") <= MAX_LINE) & F.startswith(F.ltrim("value"), F.lit("{"))).withColumn("m", F.from_json("value", "name string, ts_ns bigint, child boolean"))
    return found.where("m.name IS NOT NULL").select("run_id", "ord", "m.name", F.coalesce("m.ts_ns", F.lit(0)).alias("ts_ns"), F.coalesce("m.child", F.lit(False)).alias("child"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, ord, value): lines of files in order; a run is a file."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("run_id"), F.posexplode(F.split("value", "\n")).alias("ord", "value"))
    return files.select("run_id", F.col("ord").cast("bigint").alias("ord"), "value")


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    return mark_rows(_numbered_lines(spark, path))


def go_test_events(lines: DataFrame) -> DataFrame:
    """Test events from lines of JSON; output events and other lines are dropped before parsing."""
    kept = lines.where((F.octet_length("value") <= MAX_LINE) & F.startswith(F.ltrim("value"), F.lit("{")) & ~F.contains("value", F.lit('"Action":"output"')))
    found = kept.withColumn("e", F.from_json("value", "Time string, Action string, Package string, Test string, Elapsed double")).where("e.Action IS NOT NULL AND e.Package <> ''")
    return found.select("run_id", "ord", S.event_time_ns(F.col("e.Time")).alias("ts_ns"), F.col("e.Action").alias("action"), F.col("e.Package").alias("package"), F.when(F.col("e.Test") != "", F.col("e.Test")).alias("test"))


def read_go_test_json(spark: SparkSession, path: str) -> DataFrame:
    return go_test_events(_numbered_lines(spark, path))


_UNIT = "array<struct<i:int,name:string,version:string,start:double,duration:double,target:string,unblocked_units:array<int>,sections:array<array<string>>>>"


def cargo_units(pages: DataFrame) -> DataFrame:
    """Build units of timing reports (run_id, value); a report without a readable table fails."""
    raw = F.regexp_extract("value", r"(?s)const UNIT_DATA = (\[.*?\n\]);", 1)
    units = pages.select("run_id", F.from_json(raw, _UNIT).alias("units"), "value")
    checked = F.when(F.col("units").isNull(), F.raise_error(F.concat(F.lit("no unit table in report "), F.col("run_id"))).cast(_UNIT)).otherwise(F.col("units"))
    return units.select("run_id", F.posexplode(checked).alias("ord", "u")).select("run_id", F.col("ord").cast("bigint").alias("ord"), "u.*")


def cargo_spans(units: DataFrame, runs: DataFrame) -> DataFrame:
    """Spans of units and of their sections, clamped to the run; unit spans carry the graph attributes."""
    runs = runs.select("run_id", F.col("started_ns").alias("r0"))
    ns = lambda c: F.coalesce((c * 1e9).try_cast("bigint"), F.lit(0).cast("bigint"))
    rows = units.join(runs, "run_id").withColumn("started_ns", F.greatest(F.col("r0") + ns(F.col("start")), "r0"))
    rows = rows.withColumn("ended_ns", F.greatest(F.col("started_ns"), F.col("started_ns") + ns(F.col("duration"))))
    attr = lambda key, kind, value: F.struct(F.lit(key).alias("key"), F.lit(kind).alias("value_type"), value.alias("value"))
    edges = F.array_join(F.transform("unblocked_units", lambda x: x.cast("string")), ",")
    graph = F.concat(F.array(attr("cargo.unit", "int", F.col("i").cast("string"))), F.when(F.size("unblocked_units") > 0, F.array(attr("cargo.unblocks", "str", edges))).otherwise(F.array().cast(ATTRIBUTES)))
    own = rows.select("run_id", "ord", F.lit(None).cast("int").alias("section"), S.unit_name(F.col("name"), F.col("version"), F.col("target")).alias("name"), "started_ns", "ended_ns", graph.alias("attributes"))
    parts = rows.select("run_id", "ord", F.posexplode("sections").alias("section", "s"), "started_ns", "ended_ns").withColumn("t", F.from_json(F.col("s")[1], "start double, end double"))
    a = S.clamp(F.col("started_ns") + ns(F.col("t.start")), F.col("started_ns"), F.col("ended_ns"))
    b = F.least("ended_ns", F.col("started_ns") + ns(F.col("t.end")))
    parts = parts.select("run_id", "ord", "section", F.col("s")[0].alias("name"), a.alias("started_ns"), F.greatest(a, b).alias("ended_ns"), F.array(attr("cargo.section", "str", F.col("s")[0])).alias("attributes"))
    return own.unionByName(parts)


_CASE = "array<struct<_name:string,_time:double,failure:string,error:string,skipped:string>>"
_SUITE = f"_name string, _time double, testcase {_CASE}, testsuite array<struct<_name:string,_time:double,testcase:{_CASE}>>"


def junit_cases(pages: DataFrame) -> DataFrame:
    """Cases of test reports (run_id, value) as `suite_layout` takes them; wrapped and bare roots; other text fails."""
    root = F.regexp_extract("value", r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|\s)*<([A-Za-z]+)", 1)
    parsed = pages.select("run_id", F.from_xml("value", _SUITE).alias("x"), root.alias("root"))
    bad = ~F.col("root").isin("testsuites", "testsuite")
    bare = F.array(F.struct(F.col("x._name").alias("_name"), F.col("x._time").alias("_time"), F.col("x.testcase").alias("testcase")))
    kind = f"array<struct<_name:string,_time:double,testcase:{_CASE}>>"
    suites = F.when(bad, F.raise_error(F.concat(F.lit("no test report: "), F.col("run_id"))).cast(kind)).when(F.col("root") == "testsuite", bare.cast(kind)).otherwise(F.col("x.testsuite"))
    rows = parsed.select("run_id", F.posexplode(suites).alias("suite", "s")).select("run_id", F.col("suite"), F.col("s._name").alias("suite_name"), F.col("s._time").alias("suite_seconds"), F.posexplode_outer("s.testcase").alias("case_no", "c"))
    failed = F.col("c.failure").isNotNull() | F.col("c.error").isNotNull()
    return rows.select("run_id", "suite", "suite_name", "suite_seconds", "case_no", F.col("c._name").alias("case_name"), F.col("c._time").alias("case_seconds"), F.coalesce(failed, F.lit(False)).alias("failed"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, value) of whole files, for `cargo_units` and `junit_cases`."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("run_id"), "value")
