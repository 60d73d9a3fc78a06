import base64
import json
import os
import time

import pytest

from spanloom.operators.redaction import redact_spans
from spanloom.plans import registry, source_queries
from spanloom.sources import shared
from spanloom.sources.readers import otlp_spans
from spanloom.streaming import spans as streams
from tests.compare import difference
from tests.test_oracles import SF_DIR, con  # noqa: F401


def request(count):
    def span(i):
        attributes = [("note", "stringValue", "mail me@example.com"), ("http.authorization", "stringValue", "secret"), ("gen_ai.prompt", "stringValue", "hello"), ("size", "intValue", str(i))]
        kv = [{"key": k, "value": {t: v}} for k, t, v in attributes]
        ident = lambda n: base64.b64encode(n.to_bytes(8, "big")).decode()
        return {"traceId": ident(7), "spanId": ident(i + 1), "name": f"call a@b.org {i}", "startTimeUnixNano": "1000000000", "endTimeUnixNano": "2000000000", "attributes": kv}

    return json.dumps({"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": [span(i) for i in range(count)]}]}]})


def test_large_requests_arrive_and_are_redacted(spark, tmp_path):
    line = request(4000)
    assert len(line) > 1 << 20
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(line + "\n" + request(0) + "\n")
    table = str(tmp_path / "out")
    streams.ingest(streams.stream_spans(spark, str(tmp_path / "in")), table, str(tmp_path / "state")).awaitTermination()
    streams.keep_summaries(streams.stream_spans(spark, str(tmp_path / "in")), str(tmp_path / "kept"), str(tmp_path / "sums"), str(tmp_path / "state2")).awaitTermination()
    for found in (spark.read.parquet(table).collect(), spark.read.parquet(str(tmp_path / "kept")).collect()):
        assert len(found) == 4000
        for r in found:
            shown = {a.key: a.value for a in r.attributes}
            assert "example.com" not in str(r) and "b.org" not in r.name and r.name.startswith("call ")
            assert set(shown) == {"note", "http.authorization", "size"} and shown["http.authorization"] != "secret"
    assert [r.span_count for r in streams.latest_summaries(spark, str(tmp_path / "sums")).collect()] == [4000]


def test_rows_are_redacted_like_spans(spark):
    spans = otlp_spans(spark.createDataFrame([(request(20),)], "value string"))
    columns = ["span_id", "name", "attributes"]
    assert sorted(redact_spans(spans).select(columns).collect()) == sorted(redact_spans(spans).select(columns).collect())


@pytest.mark.parametrize("name", ["A1_read_otlp_json", "A13_otlp_labels", "J1_stream_spans"])
def test_traces_in_several_requests(spark, con, name, monkeypatch):  # noqa: F811
    monkeypatch.setattr(source_queries, "CHUNK", 10)
    assert difference(spark, con, registry.QUERIES[name], registry.ORACLES[name], SF_DIR) is None


def test_late_spans_are_found_by_marks_and_stored_once(spark, tmp_path):
    table, sums, late = (str(tmp_path / x) for x in ("spans", "sums", "late"))
    (tmp_path / "in").mkdir()
    for n, start in enumerate(("5000000000", "1000000000")):
        place = tmp_path / "in" / f"{n}.json"
        place.write_text(request(3 + n).replace("1000000000", start))
        os.utime(place, (1000 + n, 1000 + n))
    stream = streams.stream_spans(spark, str(tmp_path / "in"), files_per_batch=1)
    streams.keep_summaries(stream, table, sums, str(tmp_path / "state"), late=late, delay_ns=10**9).awaitTermination()
    assert sorted((r.span_id, r.batch, r.behind_ns) for r in streams.late_spans(spark, table, late).collect()) == [(f"{i:016x}", 1, 4 * 10**9) for i in range(1, 5)]
    assert set(spark.read.parquet(late).columns) == {"batch", "high", "delay_ns"} and spark.read.parquet(late).count() == 2
    assert [(r.span_count, r.started_ns) for r in streams.latest_summaries(spark, sums).collect()] == [(4, 10**9)]


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for x in range(found.size()) if (name := found.apply(x).getName()).startswith("shuffle_")}


def test_batches_and_requests_leave_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text(request(30))
    spans = streams.deduplicated(streams.stream_spans(spark, str(tmp_path / "in"), files_per_batch=1), "1 day")
    streams.ingest(spans, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    source_queries._requests(spark, "/root/testdata/sf0.001")
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_files(spark) <= before


def test_requests_are_written_by_tasks_of_bounded_size(spark, con, monkeypatch):  # noqa: F811
    monkeypatch.setattr(shared, "ROWS", 500, raising=False)
    settings = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        path = source_queries._requests(spark, SF_DIR)
        assert len(spark.read.text(path).inputFiles()) > 10
        assert spark.conf.get("spark.sql.shuffle.partitions") == "2"
        assert difference(spark, con, registry.QUERIES["A13_otlp_labels"], registry.ORACLES["A13_otlp_labels"], SF_DIR) is None
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_requests_are_collected_by_sorted_groups_of_text(spark, monkeypatch):
    plans, plain = [], source_queries._as_requests
    monkeypatch.setattr(source_queries, "_as_requests", lambda rows: plans.append(plain(rows)) or plans[-1])
    kept = spark.conf.get("spark.sql.execution.useObjectHashAggregateExec")
    path = source_queries._requests(spark, SF_DIR)
    assert spark.conf.get("spark.sql.execution.useObjectHashAggregateExec") == kept
    with shared.sized(spark, 1):
        text = plain(source_queries.view(spark, SF_DIR, "td_spans"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in text and "ObjectHashAggregate" not in text and "lambda x" not in text
    found = [json.loads(r.value)["resourceSpans"][0]["scopeSpans"][0]["spans"] for r in spark.read.text(path).collect()]
    assert sum(map(len, found)) == source_queries.view(spark, SF_DIR, "td_spans").count()
    assert all(s == sorted(s, key=lambda x: int(x["startTimeUnixNano"])) for s in found)


def test_late_requests_are_told_by_their_text(spark, monkeypatch):
    plain, batches = streams.stream_spans, []

    def arriving(spark, path, **more):
        found = [json.loads(r.value)["resourceSpans"][0]["scopeSpans"][0]["spans"] for r in spark.read.text(path).collect()]
        batches.append([{s["kind"] == "SPAN_KIND_INTERNAL" for s in x} for x in found])
        return plain(spark, path, **more)

    def parses(*_):
        raise AssertionError("requests are parsed to be told apart")

    monkeypatch.setattr(streams, "stream_spans", arriving)
    monkeypatch.setattr(source_queries.F, "get_json_object", parses)
    source_queries._arrived(spark, SF_DIR)
    early, both = batches
    assert early and all(x == {False} for x in early) and len(both) > len(early) and all(x in ({False}, {True}) for x in both)


def test_keys_of_a_long_delay_lie_on_disk(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text(request(200))
    provider = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(provider, None)
    query = streams.ingest(streams.deduplicated(streams.stream_spans(spark, str(tmp_path / "in"), files_per_batch=1), "36500 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    metrics = [o["customMetrics"] for p in query.recentProgress for o in p["stateOperators"]]
    assert metrics and all("rocksdbPutCount" in x for x in metrics)
    assert spark.conf.get(provider, None) == kept
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
