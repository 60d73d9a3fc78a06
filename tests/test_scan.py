"""Running values of keys that lie in many tasks, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import marks, scan, tree


@pytest.fixture()
def many_parts(spark):
    """Sort partitions stay as small as they are, so that few rows are many parts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(rows):
    """(key, at) -> values, by loops over every key's rows in order."""
    found, by_key = {}, {}
    for key, at, x in rows:
        by_key.setdefault(key, []).append((at, x))
    for key, own in by_key.items():
        own.sort()
        for k, (at, _) in enumerate(own):
            before, behind = [x for _, x in own[:k] if x is not None], [x for _, x in own[k + 1 :] if x is not None]
            found[key, at] = (k, sum(before), max(before, default=None), before[-1] if before else None, behind[0] if behind else None)
    return found


@pytest.mark.parametrize("hot", [0, 20, 10**6])
def test_scans_equal_loops_however_keys_are_spread(many_parts, hot):
    rng = random.Random(hot)
    keys = ["big"] * 200 + ["mid"] * 30 + [None] * 40 + [f"k{i}" for i in range(20)]
    rows = [(key, at, rng.choice([None, None, rng.randrange(-50, 50)])) for at, key in enumerate(keys)]
    rng.shuffle(rows)
    x = F.col("x")
    df = many_parts.createDataFrame(rows, "key string, at long, x long")
    got = scan.scan(df, ["key"], ["at"], hot, n=scan.position(), total=scan.sum_before(x), most=scan.max_before(x), last=scan.last_before(x), next=scan.next_after(x))
    assert set(got.columns) == {"key", "at", "x", "n", "total", "most", "last", "next"}
    assert {(r.key, r.at): (r.n, r.total, r.most, r.last, r["next"]) for r in got.collect()} == plain(rows)
    assert scan.scan(df.where("false"), ["key"], ["at"], hot, n=scan.position()).count() == 0


def test_a_run_with_most_of_all_marks_is_laid_out_by_many_tasks(many_parts, monkeypatch):
    rng = random.Random(5)
    rows = [("hot" if k % 10 else f"r{k % 7}", k, f"m{k}", rng.randrange(0, 400), rng.random() < 0.7) for k in range(300)]
    df = many_parts.createDataFrame(rows, "run_id string, ord long, name string, ts_ns long, child boolean")
    runs = df.select("run_id").distinct().select("run_id", F.lit(20).cast("bigint").alias("started_ns"), F.lit(500).cast("bigint").alias("ended_ns"))
    whole = sorted(map(tuple, marks.mark_spans(df, runs).collect()), key=str)
    spread, parts = scan._spread, []

    def counted(rows, order, values):
        assert {r.run_id for r in rows.select("run_id").distinct().collect()} == {"hot"}
        placed = rows.repartitionByRange("_key", *order).groupBy(F.spark_partition_id()).count().collect()
        parts.append(max(r["count"] for r in placed))
        return spread(rows, order, values)

    monkeypatch.setattr(scan, "HOT", 100)
    monkeypatch.setattr(scan, "_spread", counted)
    assert sorted(map(tuple, marks.mark_spans(df, runs).collect()), key=str) == whole
    assert parts and parts[0] <= 150  # of 270 rows, over four sort partitions


def test_suites_and_their_cases_over_many_tasks(many_parts, monkeypatch):
    rows = [("r", f"s{k % 40:02}", 1.0, f"s{k % 40:02}", k, 0.5 + k % 3, f"c{k}", k % 11 == 0) for k in range(200)]
    df = many_parts.createDataFrame(rows, "run_id string, suite string, suite_seconds double, suite_name string, case_no long, case_seconds double, case_name string, failed boolean")
    runs = many_parts.createDataFrame([("r", 0, 250 * 10**9)], "run_id string, started_ns long, ended_ns long")
    one = [sorted(map(tuple, x.collect())) for x in marks.suite_layout(df, runs)]
    monkeypatch.setattr(scan, "HOT", 3)
    assert [sorted(map(tuple, x.collect())) for x in marks.suite_layout(df, runs)] == one


def walked(rows):
    """(trace, span) -> position, by walking every trace from its root, siblings by start, then input order."""
    found = {}
    for trace in {r[0] for r in rows}:
        kids = {}
        for t, span, parent, start, at in rows:
            if t == trace:
                kids.setdefault(parent, []).append((start, at, span))
        todo = [x[2] for x in sorted(kids[None])]
        while todo:
            span = todo.pop()
            found[trace, span] = len([k for k in found if k[0] == trace])
            todo += [x[2] for x in sorted(kids.get(span, []), reverse=True)]
    return found


@pytest.mark.parametrize("hot", [3, 10**6])
def test_pre_order_by_counting_equals_a_walk(many_parts, monkeypatch, hot):
    rng = random.Random(11)
    rows = [("deep", f"d{k}", f"d{k - 1}" if k else None, rng.randrange(3), k) for k in range(70)]
    rows += [("wide", f"w{k}", "w0" if k else None, rng.randrange(5), 100 + k) for k in range(60)]
    for t in range(4):
        rows += [(f"t{t}", f"s{k}", f"s{rng.randrange(k)}" if k else None, rng.randrange(6), 1000 * t + k + 200) for k in range(40)]
    monkeypatch.setattr(scan, "HOT", hot)
    spans = many_parts.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, started_ns long, ord long")
    got = tree.preorder(tree.assemble_tree(spans, chains=False))
    assert "path" not in got.columns and "chain" not in got.columns
    assert {(r.trace_id, r.span_id): r.position for r in got.collect()} == walked(rows)


def test_folding_hides_what_is_below_at_any_depth(many_parts):
    rows = [("t", f"d{k}", f"d{k - 1}" if k else None, 0, k) for k in range(30)] + [("t", "e", "d2", 1, 40), ("t", "f", "e", 0, 41)]
    spans = many_parts.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, started_ns long, ord long")
    kept = tree.collapse_subtrees(tree.assemble_tree(spans, chains=False), spans.where("span_id IN ('d3', 'd9', 'f')"))
    assert {r.span_id for r in kept.collect()} == {"d0", "d1", "d2", "d3", "e", "f"}
