import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import chain, marks, timeline
from spanloom.sources import adapters, readers, store
from spanloom.streaming import spans as streams

GOOD = {"trace_id": "t", "source": "x", "spans": [{"span_id": "a", "trace_id": "t", "parent_span_id": "", "name": "n", "kind": 3, "status": "error", "started_ns": 1, "ended_ns": 2, "duration_ns": 1, "attributes": [{"key": "k", "value_type": "str", "value": "v"}], "links": None}]}


def changed(**change):
    return json.dumps(GOOD | {"spans": [GOOD["spans"][0] | change]})


DOCUMENTS = {
    "good": json.dumps(GOOD), "labels": changed(kind="client", status=2), "none": json.dumps({"trace_id": "u", "spans": []}), "field": json.dumps(GOOD | {"more": 1}), "two": json.dumps(GOOD) + " {}", "array": json.dumps(GOOD) + "], [" + json.dumps(GOOD),
    "comma": json.dumps(GOOD) + ", " + json.dumps(GOOD), "cut": json.dumps(GOOD)[:-2], "empty": "", "label": changed(kind="sideways"), "number": changed(status=9), "type": changed(started_ns="1"), "fraction": changed(ended_ns=1.5),
    "attribute": changed(attributes=[{"key": "k", "type": "str"}]), "link": changed(links=[{"trace_id": "x", "attributes": [{"odd": 1}], "odd": 2}]), "list": "[]", "large": json.dumps(GOOD | {"run_label": "x" * 2000}),
}


def test_documents_are_taken_whole_or_refused_with_reasons(spark):
    docs = spark.createDataFrame(list(DOCUMENTS.items()), "document string, value string")
    spans, refused = readers.import_traces(docs, most_bytes=1500)
    assert sorted((r.kind, r.status, r.parent_span_id, r.ord, r.attributes[0].value, r.links) for r in spans.collect()) == [(3, 2, None, 1, "v", [])] * 2
    got = {}
    for r in refused.collect():
        got.setdefault(r.document, set()).add((r.reason, r.field))
    assert got == {
        "field": {("unknown_field", "trace.more")}, "two": {("trailing_value", None)}, "array": {("trailing_value", None)}, "comma": {("trailing_value", None)}, "cut": {("malformed_json", None)}, "empty": {("malformed_json", None)},
        "label": {("unknown_label", "span.kind")}, "number": {("unknown_label", "span.status")}, "type": {("wrong_type", "span.started_ns")}, "fraction": {("wrong_type", "span.ended_ns")}, "attribute": {("unknown_field", "attribute.type")},
        "link": {("unknown_field", "link.odd"), ("unknown_field", "link_attribute.odd")}, "list": {("wrong_type", "trace")}, "large": {("too_large", None)},
    }


def test_a_refused_file_fails_the_read(spark, tmp_path):
    (tmp_path / "a.json").write_text(DOCUMENTS["good"])
    assert readers.read_trace_json(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.json").write_text(DOCUMENTS["field"])
    with pytest.raises(ValueError, match="unknown_field trace.more"):
        readers.read_trace_json(spark, str(tmp_path))


def test_three_reports_of_a_run_make_one_tree(spark):
    runs = spark.createDataFrame([("r", 100, 10_000_000_000)], "run_id string, started_ns long, ended_ns long")
    page = 'x const UNIT_DATA = [\n{"i":0,"name":"a","version":"1","start":0.5,"duration":2,"target":"","unblocked_units":[],"sections":[["front",{"start":0,"end":1}]]}\n];'
    xml = '<testsuite name="s" time="3"><testcase name="x" time="1"><failure/></testcase></testsuite>'
    event = lambda action, test=None: json.dumps({"Time": "1970-01-01T00:00:01Z", "Action": action, "Package": "example.test/mod/pkg"} | ({"Test": test} if test else {}))
    page_of = lambda text: spark.createDataFrame([("r", text)], "run_id string, value string")
    lines = spark.createDataFrame([("r", k, x) for k, x in enumerate((event("start"), event("run", "T"), event("fail", "T")))], "run_id string, ord long, value string")
    found = marks.mark_spans(spark.createDataFrame([("r", 1, "build", 200, False), ("r", 2, "step", 300, True)], "run_id string, ord long, name string, ts_ns long, child boolean"), runs)
    rows = adapters.run_spans(runs, {"cargo": page_of(page), "gotest": lines, "junit": page_of(xml)}, found, module="example.test/mod")
    got = {r.span_id: (r.parent_span_id, r.name, r.status) for r in rows.collect()}
    assert got == {
        "root": (None, "run", 1), "mark/1": ("root", "build", 1), "mark/2": ("mark/1", "step", 1), "cargo/0": ("root", "a v1", 1), "cargo/0/0": ("cargo/0", "front", 1),
        "gotest/example.test/mod/pkg": ("root", "pkg", 1), "gotest/example.test/mod/pkg//T": ("gotest/example.test/mod/pkg", "T", 2), "junit/0": ("root", "s", 2), "junit/0/0": ("junit/0", "x", 2),
    }
    assert {r.span_id for r in timeline.without_sections(rows).collect()} == set(got) - {"mark/2", "cargo/0/0"}
    assert timeline.waterfall(timeline.without_sections(rows), with_gaps=False).count() == 7
    assert adapters.names() == ["cargo", "gotest", "junit"]
    with pytest.raises(ValueError, match="cargo, gotest, junit"):
        adapters.lookup("other")


def test_reports_lengthen_their_run_where_asked(spark):
    cases = spark.createDataFrame([("r", 0, "s", 1.0, 0, "a", 4.0, False), ("r", 1, "t", 6.0, 0, "b", 2.0, False)], "run_id string, suite int, suite_name string, suite_seconds double, case_no int, case_name string, case_seconds double, failed boolean")
    runs = spark.createDataFrame([("r", 0, 5_000_000_000)], "run_id string, started_ns long, ended_ns long")
    ends = lambda extend: {r.name: r.ended_ns // 10**9 for r in marks.suite_layout(cases, runs, extend)[0].collect()}
    assert ends(False) == {"s": 4, "t": 5} and ends(True) == {"s": 4, "t": 10}


def test_one_report_a_trace(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, "y"), ("a", 2, "z"), ("a", 1, "x")], "trace_id string, position int, name string")
    store.write_reports(rows, str(tmp_path / "reports"))
    got = sorted(json.loads(r.value)["trace_id"] + "".join(x["name"] for x in json.loads(r.value)["rows"]) for r in spark.read.text(str(tmp_path / "reports")).collect())
    assert got == ["axz", "by"]


def test_silent_traces_are_summed_up(spark, tmp_path):
    minute = 60 * 10**9
    rows = [("a", 0, minute), ("a", 10 * minute, 11 * minute), ("b", 5 * minute, 6 * minute), ("z", 900 * minute, 901 * minute), ("z", 2000 * minute, 2001 * minute)]
    frame = spark.createDataFrame(rows, "trace_id string, started_ns long, ended_ns long")
    arrivals, table = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):  # the second batch moves the watermark past all but the last session
        (frame.where("started_ns < 3600000000000") if k == 0 else frame.where("started_ns > 3600000000000")).write.mode("append").parquet(arrivals)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(arrivals).withColumn("ts", F.timestamp_micros(F.expr("started_ns div 1000")))
    streams.session_summaries(stream).writeStream.format("parquet").option("path", table).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.trace_id, r.started_ns // minute, r.ended_ns // minute, r.span_count) for r in spark.read.parquet(table).collect()}
    assert {("a", 0, 11, 2), ("b", 5, 6, 1)} <= got and all(x[0] != "z" or x[1] == 900 for x in got)


def test_answers_drift(spark):
    def call(span, at, previous, answer):
        attributes = [("gen_ai.operation.name", "str", "chat"), ("gen_ai.response.id", "str", span)] + ([("gen_ai.request.previous_response.id", "str", previous)] if previous else []) + ([(chain.OWN + ".compaction.answer." + answer[0], "str", answer[1])] if answer else [])
        return ("t", span, at, attributes, [], 0, 0)

    schema = f"trace_id string, span_id string, started_ns long, attributes {readers.ATTRIBUTES}, links {readers.LINKS}, dropped_attributes_count long, dropped_links_count long"
    rows = [call("a", 1, None, ("label", "x")), call("b", 2, "a", ("label", "x")), call("c", 3, "b", ("label", "y")), call("d", 4, "c", ("fingerprint", "y")), call("e", 5, "d", None)]
    found = chain.compaction_report(spark.createDataFrame(rows, schema))[0]
    assert {r.span_id: r.answer_drift for r in found.collect()} == {"a": "unknown", "b": "unchanged", "c": "changed", "d": "unknown", "e": "unknown"}
