"""Runs that are followed give the spans of the whole, whenever their lines and ends arrive."""

import json

import pytest

from spanloom.operators import marks, tree
from spanloom.streaming import adapters

LINES, ENDS = "run_id string, ord bigint, value string", "run_id string, started_ns bigint, ended_ns bigint"


def event(action, package, test=None, second=1):
    doc = {"Time": f"2026-01-01T00:00:{second:02d}Z", "Action": action, "Package": package}
    return json.dumps(doc | ({"Test": test} if test else {}), separators=(",", ":"))


def mark(name, ts, child=False):
    return json.dumps({"name": name, "ts_ns": ts, "child": child})


class Follower:
    def __init__(self, spark, folder, adapter):
        self.spark, self.folder, self.adapter = spark, folder, adapter

    def __call__(self, lines=(), ends=()):
        at = lambda name: str(self.folder / name)
        for name, rows, schema in (("lines", lines, LINES), ("ends", ends, ENDS)):
            self.spark.createDataFrame(list(rows), schema).write.mode("append").parquet(at(name))
        arriving, ending = (self.spark.readStream.schema(schema).parquet(at(name)) for name, schema in (("lines", LINES), ("ends", ENDS)))
        adapters.follow(arriving, ending, self.adapter, at("state"), at("spans"), at("checkpoint")).awaitTermination()
        rows = adapters.latest_spans(self.spark, at("spans")).select(*self.columns).collect()
        return sorted(map(tuple, rows), key=lambda r: ["" if x is None else str(x) for x in r])


BASE = 1_767_225_600_000_000_000
SECOND = 1_000_000_000


@pytest.fixture
def tests_of(spark, tmp_path):
    found = Follower(spark, tmp_path, "gotest")
    found.columns = ["run_id", "package", "test", "status", "started_ns", "ended_ns"]
    return lambda *a, **k: [(r, p, t, s, (b - BASE) // SECOND, (e - BASE) // SECOND) for r, p, t, s, b, e in found(*a, **k)]


def test_spans_come_with_the_end_and_late_lines_change_them(tests_of):
    run = ("a", BASE, BASE + 50 * SECOND)
    assert tests_of([("a", 1, event("start", "p", second=1)), ("b", 1, event("run", "q", "T", 3)), ("a", 2, event("fail", "p", second=9))]) == []
    assert tests_of(ends=[run]) == [("a", "p", None, 2, 1, 9)]
    # a later finish and a later beginning: the last finish counts, the first beginning stays; b still runs
    assert tests_of([("a", 3, event("start", "p", second=20)), ("a", 4, event("pass", "p", second=30))]) == [("a", "p", None, 2, 1, 30)]
    # b ends; its package was never named alone and takes the run's bounds, as does the test's end
    both = [("a", "p", None, 2, 1, 30), ("b", "q", None, 1, 2, 40), ("b", "q", "T", 1, 3, 40)]
    assert tests_of(ends=[("b", BASE + 2 * SECOND, BASE + 40 * SECOND)]) == both
    # a repeated end corrects the bounds
    assert tests_of(ends=[("a", BASE, BASE + 25 * SECOND)])[0] == ("a", "p", None, 2, 1, 25)


def test_lines_that_count_for_nothing(tests_of):
    long = event("start", "x" * (1 << 20))
    lines = [("a", 0, long), ("a", 1, ""), ("a", 2, "ok  p 0.1s"), ("a", 3, "{broken"), ("a", 4, event("output", "o")), ("a", 5, None), (None, 6, event("start", "n")), ("a", 7, event("start", "p"))]
    assert tests_of(lines, [("a", BASE, BASE + 5 * SECOND), ("none", BASE, BASE)]) == [("a", "p", None, 1, 1, 5)]


def test_marks_in_any_order(spark, tmp_path):
    found = Follower(spark, tmp_path, "marks")
    found.columns = ["run_id", "ord", "name", "child", "started_ns", "ended_ns"]
    assert found([("m", 3, mark("test", 70)), ("m", 2, mark("unit", 30, True))]) == []
    assert found(ends=[("m", 10, 100)]) == [("m", 2, "unit", True, 30, 70), ("m", 3, "test", False, 70, 100)]
    # the first section comes late and again
    late = [("m", 1, mark("build", 20)), ("m", 9, mark("build", 20))]
    assert found(late) == [("m", 1, "build", False, 20, 70), ("m", 2, "unit", True, 30, 70), ("m", 3, "test", False, 70, 100)]


def test_no_rows(tests_of):
    assert tests_of() == []


def test_own_adapter(spark, tmp_path):
    rows = lambda lines: lines.selectExpr("run_id", "ord", "length(value) AS n")
    total = lambda parts: parts.groupBy("run_id").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    found = Follower(spark, tmp_path, adapters.StreamAdapter(rows, total, total, lambda parts, runs: parts.join(runs, "run_id")))
    found.columns = ["run_id", "n"]
    found([("a", 1, "xx"), ("a", 2, "yyy")])
    assert found([("a", 3, "z")], [("a", 0, 1)]) == [("a", 6)]


def test_parts_of_parts_fold_like_the_whole(spark):
    rows = [("r", i, (7 * i) % 50, ("start", "pass", "fail", "output", "pause")[i % 5], "p", None if i % 3 else "t") for i in range(40)]
    events = spark.createDataFrame(rows, "run_id string, ord bigint, ts_ns bigint, action string, package string, test string")
    runs = spark.createDataFrame([("r", 5, 45)], ENDS)
    halves = marks.go_test_parts(events.where("ord % 2 = 0")).unionByName(marks.go_test_parts(events.where("ord % 2 = 1")))
    split = marks.go_test_spans(marks.go_test_merged(halves), runs)
    assert sorted(split.collect(), key=str) == sorted(marks.go_test_fold(events, runs).collect(), key=str)


def test_marked_ancestors_of_orphans_and_cycles(spark):
    # 0 <- 1 <- ... <- 99; lost <- o0 <- o1; x -> y -> z -> x with w below; another trace
    rows = [("t", str(i), str(i - 1) if i else None) for i in range(100)]
    rows += [("t", "o0", "lost"), ("t", "o1", "o0"), ("t", "x", "y"), ("t", "y", "z"), ("t", "z", "x"), ("t", "w", "x"), ("t", "self", "self"), ("u", "5", None), ("u", "6", "5")]
    spans = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "trace_id string, span_id string, parent_span_id string, ord bigint")
    marked = {("t", s) for s in ("3", "50", "o0", "z", "self", "lost")}
    parents = {(t, s): p for t, s, p in rows}
    wanted = set()
    for t, s, up in rows:
        seen = set()
        while up is not None and (t, up) in parents and up not in seen:
            seen.add(up)
            if (t, up) in marked:
                wanted.add((t, s, up))
            up = parents[t, up]
    found = tree.marked_ancestors(spans, spark.createDataFrame(sorted(marked), "trace_id string, span_id string"))
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
