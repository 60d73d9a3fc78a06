"""Registered queries over readers, the store and streams.

Their files are written by Spark from the projections, so they grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import marks, timeline
from spanloom.plans.projections import sql, view
from spanloom.plans.trace_queries import ORACLES, _runs, register
from spanloom.sources import adapters as reports
from spanloom.sources import readers, store
from spanloom.sources.shared import bucketed, discard, folder, lean, sized
from spanloom.streaming import adapters
from spanloom.streaming import spans as streams

#: most spans of a request
CHUNK = 1000


def _requests(spark, sf_dir, *apart: str) -> str:
    """The spans as exported requests, one a line, of at most CHUNK spans of a trace, in compressed files.

    Spans that differ in the expressions `apart` are in requests of their own.
    """
    path = folder(spark, "requests")
    rows = sum(spark.read.parquet(f"{sf_dir}/{table}.parquet").count() for table in ("orders", "lineitem"))
    # spans are sorted and collected by tasks that do not spill, however few partitions the session names
    with lean(spark), sized(spark, rows):
        _as_requests(view(spark, sf_dir, "td_spans"), *apart).write.text(path, compression="gzip")
    return path


def _as_requests(rows, *apart: str):
    """Requests of spans; placed by trace like the spans, so what is collected is not shuffled again."""
    kinds, codes = F.array(*map(F.lit, ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT"))), F.array(*map(F.lit, ("UNSET", "OK", "ERROR")))
    id64 = lambda c: F.base64(F.col(c).cast("binary"))
    kv = F.array(F.struct(F.lit("size").alias("key"), F.struct((F.col("duration_ns") % 1000003).cast("string").alias("intValue")).alias("value")))
    span = F.struct(
        id64("trace_id").alias("traceId"), id64("span_id").alias("spanId"), id64("parent_span_id").alias("parentSpanId"), "name", F.concat(F.lit("SPAN_KIND_"), F.element_at(kinds, F.col("kind") + 1)).alias("kind"),
        F.col("started_ns").cast("string").alias("startTimeUnixNano"), F.col("ended_ns").cast("string").alias("endTimeUnixNano"), kv.alias("attributes"), F.struct(F.concat(F.lit("STATUS_CODE_"), F.element_at(codes, F.col("status") + 1)).alias("code")).alias("status"),
    )
    # spans are collected as text, which is copied and sorted for less than nested columns
    docs = rows.groupBy("trace_id", F.expr(f"ord div {CHUNK}").alias("chunk"), *map(F.expr, apart)).agg(F.sort_array(F.collect_list(F.struct("ord", F.to_json(span).alias("s")))).alias("s"))
    spans = F.array_join(F.transform("s", lambda x: x["s"]), ",")
    return docs.select(F.concat(F.lit(_BEFORE), spans, F.lit("]}]}]}")).alias("value"))


#: what comes before the spans of a request
_BEFORE = '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"shop"}}]},"scopeSpans":[{"spans":['

_HEX = "lower(hex({0}))"
_SPANS = f"""{sql('td_spans')} SELECT {_HEX.format('trace_id')} AS trace_id, {_HEX.format('span_id')} AS span_id, {_HEX.format('parent_span_id')} AS parent_span_id, name, kind, status, started_ns, ended_ns, duration_ns,
  (duration_ns % 1000003)::VARCHAR AS size FROM td_spans"""
_KEPT = f"{sql('td_kept')} SELECT {_SPANS.rsplit(' SELECT ', 1)[1]}".removesuffix("td_spans") + "td_kept"
_KEPT_SUMMARY = f"{sql('td_kept')} SELECT {ORACLES['D1_trace_summary'].rsplit(' SELECT ', 1)[1]}".replace("FROM td_spans GROUP BY", "FROM td_kept GROUP BY")
_COLUMNS = ["trace_id", "span_id", "parent_span_id", "name", "kind", "status", "started_ns", "ended_ns", "duration_ns"]


def _shown(rows):
    return rows.select(*_COLUMNS, F.element_at("attributes", 1)["value"].alias("size"))


@register("A1_read_otlp_json", _SPANS)
def otlp(spark, sf_dir):
    return _shown(readers.read_otlp_json(spark, _requests(spark, sf_dir), whole=False))


@register("A13_otlp_labels", f"SELECT {_HEX.format('trace_id')} AS trace_id, 'shop · ' || root_name AS run_label FROM ({ORACLES['D1_trace_summary']})")
def labels(spark, sf_dir):
    return readers.trace_labels(readers.read_otlp_json(spark, _requests(spark, sf_dir), whole=False))


@register("A8_A9_store_round_trip", f"{sql('td_kept')} SELECT trace_id, span_id, parent_span_id, name, kind, status, started_ns, ended_ns, duration_ns, row_number() OVER (PARTITION BY trace_id ORDER BY ord) AS ord, name AS size FROM td_kept")
def round_trip(spark, sf_dir):
    attr = F.array(F.struct(F.lit("label").alias("key"), F.lit("str").alias("value_type"), F.col("name").alias("value")))
    zero = F.lit(0).cast("bigint")
    rows = view(spark, sf_dir, "td_spans").select(*_COLUMNS, "ord", attr.alias("attributes"), F.array().cast(readers.LINKS).alias("links"), zero.alias("dropped_attributes_count"), zero.alias("dropped_links_count"))
    path = folder(spark, "store")
    # the projection's traces start on thousands of days
    store.write_spans(rows, path, "tests", grain="year")
    return store.read_spans(spark, path).select(*_COLUMNS, "ord", F.element_at("attributes", 1)["value"].alias("size"))


def _go_test_lines(spark, sf_dir):
    """Events as lines of test output, and the runs they belong to."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    action = F.element_at(F.array(*map(F.lit, ("start", "run", "pass", "fail", "skip", "output", "pause"))), (F.col("event_id") % 7 + 1).cast("int"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    time = F.concat(F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))
    doc = F.struct(time.alias("Time"), action.alias("Action"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("Package"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string"))).alias("Test"))
    lines = ev.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), F.to_json(doc).alias("value"))
    runs = ev.groupBy(F.col("user_id").alias("run_id")).agg((F.min(micros) * 1000 + 1_000_000).alias("started_ns"), (F.max(micros) * 1000 - 1_000_000).alias("ended_ns"))
    return lines, runs


@register("A6_read_go_test_json", ORACLES["D4_go_test_fold"])
def go_test(spark, sf_dir):
    lines, runs = _go_test_lines(spark, sf_dir)
    path = folder(spark, "gotest")
    lines.write.parquet(path)
    return marks.go_test_fold(readers.go_test_events(spark.read.parquet(path)), runs)


def _followed(spark, lines, runs, adapter):
    """Lines arrive in three batches; the runs end with the second, the last lines are late."""
    arrivals, ended, state, out, checkpoint = (folder(spark, x) for x in ("lines", "ends", "parts", "followed", "state"))
    for turn in range(3):
        lines.where(F.col("ord") % 3 == turn).write.mode("append").parquet(arrivals)
        (runs if turn == 1 else runs.limit(0)).write.mode("append").parquet(ended)
        arriving, ending = (spark.readStream.schema(x.schema).parquet(path) for x, path in ((lines, arrivals), (runs, ended)))
        adapters.follow(arriving, ending, adapter, state, out, checkpoint).awaitTermination()
    return adapters.latest_spans(spark, out)


@register("J4_N2_stream_go_test", ORACLES["D4_go_test_fold"])
def stream_go_test(spark, sf_dir):
    return _followed(spark, *_go_test_lines(spark, sf_dir), "gotest")


@register("J5_N2_stream_marks", ORACLES["E1_E2_mark_spans"])
def stream_marks(spark, sf_dir):
    rows = view(spark, sf_dir, "td_marks")
    lines = rows.select("run_id", "ord", F.to_json(F.struct("name", "ts_ns", "child")).alias("value"))
    return _followed(spark, lines, _runs(rows), "marks")


@register("A4_read_marks", ORACLES["D3_dedup_marks"])
def mark_lines(spark, sf_dir):
    rows = view(spark, sf_dir, "td_marks")
    path = folder(spark, "marks")
    rows.select("run_id", "ord", F.to_json(F.struct("name", "ts_ns", "child")).alias("value")).unionByName(rows.limit(5).select("run_id", "ord", F.lit("{broken").alias("value"))).write.parquet(path)
    return marks.dedup_marks(readers.mark_rows(spark.read.parquet(path))).select("run_id", "ord", "name", "ts_ns", "child")


@register("A7_read_junit_xml", ORACLES["E9_case_layout"].replace("i.name, CASE", "i.name, CASE").replace("SELECT i.run_id, i.suite, i.case_no, i.name,", "SELECT i.run_id, i.suite AS suite_name, i.case_no - 1 AS case_no, i.name,"))
def junit(spark, sf_dir):
    rows = _suite_rows(spark, sf_dir)
    case = F.when(F.col("case_no").isNotNull(), F.concat(F.lit('<testcase name="'), "case_name", F.lit('" time="'), F.col("case_seconds").cast("bigint").cast("string"), F.lit('">'), F.when(F.col("failed"), "<failure/>").otherwise(""), F.lit("</testcase>")))
    body = rows.groupBy("o_orderkey", "run_id", "suite_seconds").agg(F.sort_array(F.collect_list(F.struct("case_no", case.alias("x")))).alias("c"))
    body = body.withColumn("suite", F.expr("'o' || o_orderkey"))
    inner = F.array_join(F.transform("c", lambda x: F.coalesce(x["x"], F.lit(""))), "")
    suite = F.concat(F.lit('<testsuite name="'), "suite", F.lit('" time="'), F.col("suite_seconds").cast("bigint").cast("string"), F.lit('">'), inner, F.lit("</testsuite>"))
    docs = body.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("suite", suite.alias("x")))).alias("s"))
    path = folder(spark, "junit")
    with lean(spark):
        docs.select("run_id", F.concat(F.lit('<?xml version="1.0"?>\n<testsuites>'), F.array_join(F.transform("s", lambda x: x["x"]), ""), F.lit("</testsuites>")).alias("value")).write.parquet(path)
    pages = spark.read.parquet(path)
    # read once; all cases of a run lie in one bucket, so their layout shuffles suites alone
    cases = bucketed(readers.junit_cases(pages.repartition("run_id")), "cases", "run_id")
    discard(path)
    runs = cases.select("run_id").distinct().select("run_id", F.lit(0).cast("bigint").alias("started_ns"), F.lit(2_000_000_000_000_000).alias("ended_ns"))
    found, tests = marks.suite_layout(cases, runs)
    names = found.select("run_id", "suite", F.col("name").alias("suite_name"))
    return tests.join(names, ["run_id", "suite"]).select("run_id", "suite_name", "case_no", "name", "status", "started_ns", "ended_ns")


def _suite_rows(spark, sf_dir):
    """Orders as suites with their lines as cases, by one shuffle of orders and one of lines by order."""
    from pyspark.sql import Window

    # numbers, joins and reports of orders all keep to the one placing by order
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", "'c' || o_custkey AS run_id", "unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS o_us")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(l_quantity AS BIGINT) * 3600 AS hours_s", "l_returnflag <=> 'R' AS failed")
    number = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("case_name"))
    cases = orders.join(lines, "o_orderkey").withColumn("case_name", F.expr("'l' || o_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"))
    cases = cases.select("o_orderkey", "run_id", number.alias("case_no"), "case_name", F.expr("CASE WHEN o_us IS NOT NULL AND l_partkey IS NOT NULL THEN CAST(hours_s AS DOUBLE) END AS case_seconds"), "failed")
    suites = orders.select("o_orderkey", "run_id", F.expr("CAST(o_us div 1000000 % 500000 AS DOUBLE) AS suite_seconds"))
    return suites.join(cases, ["o_orderkey", "run_id"], "left")


@register("J1_stream_spans", _SPANS)
def stream(spark, sf_dir):
    path, table = _requests(spark, sf_dir), folder(spark, "streamed")
    streams.ingest(streams.stream_spans(spark, path), table, folder(spark, "state")).awaitTermination()
    return _shown(spark.read.parquet(table))


#: batches of J2's delivery, each of which shuffles its share of the spans; few enough for the state to be written only once
_BATCHES = 8


@register("J2_stream_dedup", _KEPT)
def stream_dedup(spark, sf_dir):
    path, table, state = _requests(spark, sf_dir), folder(spark, "streamed"), folder(spark, "state")
    files = -(-len(spark.read.text(path).inputFiles()) // _BATCHES)
    # two streams deliver every request; the delay covers the whole span of event times
    once, again = (streams.stream_spans(spark, path, files_per_batch=max(1, files)) for _ in range(2))
    spans = streams.deduplicated(once.unionByName(again), "36500 days")
    streams.ingest(spans, table, state).awaitTermination()
    discard(path, state)
    return _shown(spark.read.parquet(table))


@register("J6_late_spans", f"SELECT {_HEX.format('trace_id')} AS trace_id, started_ns, ended_ns, root_name, span_count, duration_ns FROM ({_KEPT_SUMMARY})")
def late(spark, sf_dir):
    """Leaf spans come a batch after the others, and change the summaries of their traces."""
    summaries = _arrived(spark, sf_dir)[0]
    return streams.latest_summaries(spark, summaries).select("trace_id", "started_ns", "ended_ns", "root_name", "span_count", "duration_ns")


#: nanoseconds that a span may be behind in J6_late_rows: a year
_DELAY = 365 * 86400 * 10**9


@register("J6_late_rows", f"""{sql('td_spans')}, h AS (SELECT max(started_ns) AS high FROM td_spans WHERE kind <> 1)
  SELECT {_HEX.format('trace_id')} AS trace_id, {_HEX.format('span_id')} AS span_id, high - started_ns AS behind_ns FROM td_spans, h WHERE kind = 1 AND high - started_ns > {_DELAY}""")
def late_rows(spark, sf_dir):
    return streams.late_spans(spark, *_arrived(spark, sf_dir)[1:]).select("trace_id", "span_id", "behind_ns")


def _arrived(spark, sf_dir):
    """Summaries, spans and marks of late ones after two batches, the second of which has the leaf spans."""
    path, first = _requests(spark, sf_dir, "kind = 1"), folder(spark, "arrivals")
    table, summaries, late, state = (folder(spark, x) for x in ("spans", "summaries", "late", "state"))
    docs = spark.read.text(path)
    # a request has either leaf spans or none; quotes within texts are escaped
    leaves = F.contains("value", F.lit('"kind":"SPAN_KIND_INTERNAL"'))
    for early in (True, False):
        docs.where(~leaves if early else leaves).write.mode("append").text(first, compression="gzip")
        if not early:
            discard(path)
        streams.keep_summaries(streams.stream_spans(spark, first, files_per_batch=100_000), table, summaries, state, late=late, delay_ns=_DELAY).awaitTermination()
    discard(first)
    return summaries, table, late


#: every seventh document each has a field too many, a second value, an unknown label, an attribute with a field too many, or is cut short
_DOCUMENTS = f"""{sql('td_usage')}, d AS (SELECT *, trace_id AS document, substr(trace_id, 2)::BIGINT % 7 AS fault FROM td_usage)"""


def _documents(spark, sf_dir):
    """Conversations as stored-trace documents."""
    attribute = lambda odd: F.struct(F.lit("provider").alias("key"), F.lit("str").alias("value_type"), F.col("provider").alias("value"), F.when(odd, "1").alias("extra"))
    fault = F.substring("trace_id", 2, 20).cast("bigint") % 7
    span = F.struct(
        "started_ns", "span_id", "trace_id", F.coalesce("prev", F.lit("")).alias("parent_span_id"), F.col("mode").alias("name"), F.when(fault == 3, "sideways").otherwise("client").alias("kind"), F.lit(2).alias("status"),
        (F.col("started_ns") + F.col("output_tokens")).alias("ended_ns"), F.col("output_tokens").alias("duration_ns"), F.array(attribute(fault == 4)).alias("attributes"),
    )
    docs = view(spark, sf_dir, "td_usage").groupBy("trace_id").agg(F.sort_array(F.collect_list(span)).alias("spans")).withColumn("fault", fault)
    text = F.to_json(F.struct("trace_id", F.lit("tests").alias("source"), "spans", F.when(F.col("fault") == 1, 5).alias("color")))
    cut = F.when(F.col("fault") == 2, F.concat(text, F.lit(" {}"))).when(F.col("fault") == 5, F.expr("left(text, char_length(text) - 3)")).otherwise(F.col("text"))
    return docs.withColumn("text", text).select(F.col("trace_id").alias("document"), F.when(F.col("fault") == 2, F.concat("text", F.lit(" {}"))).otherwise(cut).alias("value"))


def _stored(spark, sf_dir):
    docs, path = _documents(spark, sf_dir), folder(spark, "documents")
    docs.write.parquet(path)
    return readers.import_traces(spark.read.parquet(path))


@register("A3_import_traces", f"""{_DOCUMENTS} SELECT trace_id, span_id, prev AS parent_span_id, mode AS name, 3 AS kind, 2 AS status, started_ns, started_ns + output_tokens AS ended_ns,
  row_number() OVER (PARTITION BY trace_id ORDER BY started_ns) AS ord, provider FROM d WHERE fault IN (0, 6)""")
def imported(spark, sf_dir):
    found = _stored(spark, sf_dir)[0]
    return found.select("trace_id", "span_id", "parent_span_id", "name", "kind", "status", "started_ns", "ended_ns", "ord", F.col("attributes")[0]["value"].alias("provider"))


@register("A3_refused_documents", f"""{_DOCUMENTS} SELECT DISTINCT document, (['unknown_field', 'trailing_value', 'unknown_label', 'unknown_field', 'malformed_json'])[fault] AS reason,
  (['trace.color', NULL, 'span.kind', 'attribute.extra', NULL])[fault] AS field FROM d WHERE fault BETWEEN 1 AND 5""")
def refused(spark, sf_dir):
    return _stored(spark, sf_dir)[1]


_UNITS_OF = """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, event_type FROM events WHERE event_id % 5 = 0"""


def _pages(spark, sf_dir):
    """Every fifth event of a user as a unit of a build report."""
    from pyspark.sql import Window

    ev = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 5 = 0")
    ev = ev.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    unit = F.struct("i", F.col("event_type").alias("name"), F.lit("1").alias("version"), F.lit(0.0).alias("start"), F.col("i").cast("double").alias("duration"), F.lit("").alias("target"), F.array().cast("array<int>").alias("unblocked_units"))
    found = ev.groupBy(F.col("user_id").alias("run_id")).agg(F.to_json(F.sort_array(F.collect_list(unit))).alias("units"))
    return found.select("run_id", F.concat(F.lit("const UNIT_DATA = "), F.expr("left(units, char_length(units) - 1)"), F.lit("\n];")).alias("value"))


_RUN_OF = "SELECT user_id AS run_id, min(epoch_us(ts)) * 1000 + 1000000 AS r0, max(epoch_us(ts)) * 1000 - 1000000 AS r1 FROM events GROUP BY user_id"


@register("I4_N1_run_reports", f"""SELECT run_id::VARCHAR AS trace_id, 'root' AS span_id, NULL AS parent_span_id, 'run' AS name, 1 AS status, r0 AS started_ns, r1 AS ended_ns FROM ({_RUN_OF})
  UNION ALL SELECT run_id::VARCHAR, 'gotest/' || package || coalesce('//' || test, ''), CASE WHEN test IS NULL THEN 'root' ELSE 'gotest/' || package END, coalesce(test, package), status, started_ns, ended_ns FROM ({ORACLES['D4_go_test_fold']})
  UNION ALL SELECT u.user_id::VARCHAR, 'cargo/' || i, 'root', event_type || ' v1', 1, r0, r0 + i * 1000000000 FROM ({_UNITS_OF}) u JOIN ({_RUN_OF}) r ON r.run_id = u.user_id
  UNION ALL SELECT m.user_id::VARCHAR, 'mark/' || event_id, 'root', event_type, 1, greatest(epoch_us(ts) * 1000, r0), greatest(greatest(epoch_us(ts) * 1000, r0), coalesce(
    lead(epoch_us(ts) * 1000) OVER (PARTITION BY m.user_id ORDER BY ts, event_id), r1)) FROM events m JOIN ({_RUN_OF}) r ON r.run_id = m.user_id WHERE event_id % 4 = 0""")
def run_reports(spark, sf_dir):
    """Root, sections, a build report and test output of every user's run; sub-sections are left out."""
    lines, runs = _go_test_lines(spark, sf_dir)
    rows = view(spark, sf_dir, "td_marks").where("ord % 4 = 0 OR child")
    rows = rows.withColumn("child", F.col("ord") % 4 != 0)
    found = reports.run_spans(runs, {"gotest": lines, "cargo": _pages(spark, sf_dir)}, marks.mark_spans(rows, runs))
    return timeline.without_sections(found).select("trace_id", "span_id", "parent_span_id", "name", "status", "started_ns", "ended_ns")
