"""What is shuffled, and what no longer is."""

import glob
import time

from pyspark.sql import functions as F

from spanloom.operators import critical, marks, timeline, tree
from spanloom.plans import projections, source_queries, trace_queries

SF_DIR = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_span_projection_shuffles_orders_lines_and_spans_once(spark):
    found = projections.view(spark, SF_DIR, "td_spans")
    text = projections.sql("td_spans", duckdb=False)
    plain = spark.sql(f"{text} SELECT * FROM td_spans", **{t: spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("orders", "lineitem")})
    assert found.select(plain.columns).exceptAll(plain).isEmpty() and found.count() == plain.count()
    assert shuffles(found) <= 3


def test_trees_are_joined_where_they_lie(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = tree.assemble_tree(projections.view(spark, SF_DIR, "td_spans"), chains=False)
        assert shuffles(found) == 0 and shuffles(timeline.ranked(found, 8)) == 0
        assert shuffles(tree.preorder(found)) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_requests_are_compressed(spark):
    path = source_queries._requests(spark, SF_DIR).removeprefix("file://")
    files = glob.glob(f"{path}/part-*")
    assert files and all(x.endswith(".gz") for x in files)


def test_nameless_spans_match_nothing_in_a_diff(spark):
    rows = [(t, i, p, n, s, 5, s) for t in ("a", "b") for i, p, n, s in (("r", None, "root", 1), ("k", "r", None, 2))]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, name string, started_ns long, duration_ns long, ord long")
    found = timeline.diff_traces(spans, spark.createDataFrame([("a", "b")], "a string, b string"))
    assert [(r.position, r.kind, r.name) for r in found.orderBy("position").collect()] == [(0, "matched", "root"), (1, "removed", None), (2, "added", None)]


def test_reports_of_tests_are_read_once_and_laid_out_once(spark, monkeypatch):
    names, plain = [], marks.materialize
    monkeypatch.setattr(marks, "materialize", lambda df, name: names.append(name) or plain(df, name))
    found = source_queries.junit(spark, SF_DIR)
    assert names == ["suites"] and "from_xml" not in found._jdf.queryExecution().toString()
    assert shuffles(source_queries._suite_rows(spark, SF_DIR)) <= 3


def test_units_are_placed_by_trace_by_one_shuffle_of_orders_and_lines(spark, monkeypatch):
    for name in ("td_units", "td_units_ok"):
        found = projections.view(spark, SF_DIR, name)
        text = projections.sql(name, duckdb=False)
        plain = spark.sql(f"{text} SELECT * FROM {name}", **{t: spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("orders", "lineitem")})
        assert found.columns == plain.columns and found.dtypes == plain.dtypes
        assert found.exceptAll(plain).isEmpty() and found.count() == plain.count()
    plans, plain = [], critical.bucketed
    monkeypatch.setattr(critical, "bucketed", lambda df, name: plans.append(df) or plain(df, name))
    critical._solved(critical._parsed(trace_queries._unit_spans(spark, SF_DIR, "td_units_ok")), F.col("ord"))
    assert shuffles(plans[0]) <= 2


def test_reports_are_validated_in_one_pass(spark):
    found = trace_queries.critical_broken(spark, SF_DIR)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 3
    report = spark.createDataFrame([("a", "ok", 5, 4, 2), ("b", "cyclic", 1, 2, 0)], "trace_id string, status string, critical_ns long, total_work_ns long, path_count long")
    path = spark.createDataFrame([("a", 2), ("a", 2)], "trace_id string, duration_ns long")
    assert sorted(map(tuple, critical.validate(report, path).collect())) == [("a", "path_sum"), ("a", "work_below_path"), ("b", "path_without_ok")]


def test_stored_spans_are_shuffled_once_a_table_and_leave_no_shuffle_files(spark, tmp_path, monkeypatch):
    from spanloom.sources import store
    from tests.test_streaming import shuffle_files

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before, plans, plain = shuffle_files(spark), [], store.materialize
    monkeypatch.setattr(store, "materialize", lambda df, name: plans.append(df) or plain(df, name))
    try:
        attributes = F.array(F.struct(F.lit("label").alias("key"), F.lit("str").alias("value_type"), F.col("name").alias("value")))
        rows = projections.view(spark, SF_DIR, "td_spans").withColumn("attributes", attributes).withColumn("links", F.array().cast(store.LINKS))
        rows = rows.withColumns({c: F.lit(0).cast("bigint") for c in ("dropped_attributes_count", "dropped_links_count")})
        store.write_spans(rows, str(tmp_path), "tests", grain="year")
        assert "trace_date" in plans[0].columns and shuffles(plans[0]) <= 3
        for _ in range(50):
            if shuffle_files(spark) <= before:
                break
            time.sleep(0.2)
        assert shuffle_files(spark) <= before
        assert shuffles(store.read_spans(spark, str(tmp_path)).drop("links")) <= 2
        stored, traces = (spark.read.parquet(str(tmp_path / x)) for x in ("spans", "traces"))
        dates = stored.groupBy("trace_id", "trace_date").agg(F.count("*").alias("span_count"))
        assert dates.exceptAll(traces.select(dates.columns)).isEmpty() and dates.count() == traces.count() > 10
        assert traces.where("year(timestamp_micros(started_ns div 1000)) <> year(trace_date)").isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
