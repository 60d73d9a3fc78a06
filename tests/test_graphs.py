import json
import random

import pytest

from spanloom.operators import critical
from spanloom.sources import rates


def brute_path(units, edges):
    """Longest path by plain dynamic programming, units in order (edges go upwards)."""
    best, pred = {}, {}
    for u in sorted(units):
        into = [(best[a], -a) for a, b in edges if b == u]
        top = max(into, default=None)
        best[u], pred[u] = units[u] + (top[0] if top else 0), -top[1] if top else None
    end = min(u for u in units if best[u] == max(best.values()))
    path = [end]
    while pred[path[-1]] is not None:
        path.append(pred[path[-1]])
    return max(best.values()), path[::-1]


def spans(spark, graphs):
    rows = []
    for name, (units, edges) in graphs.items():
        rows += [(name, f"{name}-{u}", u, d, str(u), ",".join(str(b) for a, b in edges if a == u) or None) for u, d in units.items()]
    return spark.createDataFrame(rows, "trace_id string, span_id string, ord long, duration_ns long, unit_text string, unblocks_text string")


def test_paths_of_random_graphs(spark):
    rng, graphs = random.Random(4), {}
    for k in range(12):
        n = rng.randint(1, 14)
        units = {u: rng.randint(0, 5) for u in range(n)}
        graphs[f"g{k}"] = (units, sorted({(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.3}))
    report, path, issues = critical.critical_path(spans(spark, graphs))
    assert issues.isEmpty() and critical.validate(report, path).isEmpty()
    got = {}
    for r in path.orderBy("trace_id", "position").collect():
        got.setdefault(r.trace_id, []).append(r.unit)
    lengths = {r.trace_id: r.critical_ns for r in report.collect()}
    assert {k: (lengths[k], got[k]) for k in graphs} == {k: brute_path(*g) for k, g in graphs.items()}


def test_only_cycles_are_flagged(spark):
    graphs = {
        "two": ({u: 1 for u in range(6)}, [(0, 1), (1, 2), (2, 1), (2, 3), (3, 4), (5, 0)]),
        "self": ({0: 1, 1: 1}, [(0, 0), (0, 1)]),
        "fine": ({0: 1, 1: 1}, [(0, 1)]),
    }
    report, _, issues = critical.critical_path(spans(spark, graphs))
    assert {(r.trace_id, r.unit) for r in issues.where("code = 'cycle'").collect()} == {("two", 1), ("two", 2), ("self", 0)}
    assert {r.trace_id: r.status for r in report.collect()} == {"two": "cyclic", "self": "cyclic", "fine": "ok"}


def on_cycles(units, edges):
    """Units that reach themselves, by plain search (self-edges included)."""
    after = {u: [b for a, b in edges if a == u] for u in units}
    out = set()
    for u in units:
        seen, todo = set(), list(after[u])
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += after[v]
        if u in seen:
            out.add(u)
    return out


def test_bridges_between_cycles_are_on_none(spark):
    rng = random.Random(6)
    graphs = {
        "bridge": ({u: 1 for u in range(1, 6)}, [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4)]),
        "ring": ({u: 1 for u in range(40)}, [(u, (u + 1) % 40) for u in range(40)]),
        "eight": ({u: 1 for u in range(21)}, [(u, u + 1) for u in range(10)] + [(10, 0), (0, 11)] + [(u, u + 1) for u in range(11, 20)] + [(20, 0)]),
        "long": ({u: 1 for u in range(60)}, [(u, u + 1) for u in range(59)] + [(9, 3), (50, 41), (45, 45)]),
    }
    for k in range(10):
        n = rng.randint(2, 16)
        graphs[f"r{k}"] = ({u: 1 for u in range(n)}, sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))}))
    _, _, issues = critical.critical_path(spans(spark, graphs))
    got = {name: set() for name in graphs}
    for r in issues.where("code = 'cycle'").collect():
        got[r.trace_id].add(r.unit)
    assert got == {name: on_cycles(*g) for name, g in graphs.items()}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, names = 5000, []
    plain = critical.materialize
    monkeypatch.setattr(critical, "materialize", lambda df, name: names.append(name) or plain(df, name))
    units = spark.range(n).selectExpr("'t' AS trace_id", "CAST(id AS INT) AS unit", "id % 7 AS duration_ns")
    edges = spark.range(n - 1).selectExpr("'t' AS trace_id", "CAST(id AS INT) AS src", "CAST(id + 1 AS INT) AS dst")
    # a side branch that joins the chain half way, with an equal predecessor
    edges = edges.unionByName(spark.createDataFrame([("t", 0, 2500), ("t", 2498, 2500)], "trace_id string, src int, dst int"))
    known, residue = critical.finish_times(units, edges)
    got = {r.unit: (r.finish, r.pred) for r in known.collect()}
    total, want = 0, {}
    for u in range(n):
        total += u % 7
        want[u] = (total, u - 1 if u else None)
    want[2500] = (want[2500][0], 2498)  # unit 2499 takes no time
    assert got == want and residue.isEmpty()
    assert names.count("open") + names.count("chains") < 20


def test_chains_with_floors_equal_plain_paths(spark, monkeypatch):
    monkeypatch.setattr(critical, "PLAIN_PEELS", 0)
    rng, graphs = random.Random(11), {}
    for k in range(10):
        n = rng.randint(2, 30)
        units = {u: rng.randint(0, 5) for u in range(n)}
        graphs[f"g{k}"] = (units, sorted({(a, min(n - 1, a + rng.choice([1, 1, 1, 1, 4, 9]))) for a in range(n - 1)} | {(a, a + 1) for a in range(0, n - 1, 2)}))
    report, path, _ = critical.critical_path(spans(spark, graphs))
    got = {}
    for r in path.orderBy("trace_id", "position").collect():
        got.setdefault(r.trace_id, []).append(r.unit)
    lengths = {r.trace_id: r.critical_ns for r in report.collect()}
    assert {k: (lengths[k], got[k]) for k in graphs} == {k: brute_path(*g) for k, g in graphs.items()}


def test_a_long_path_is_walked_in_few_rounds(spark):
    n = 3000
    known = spark.range(n).selectExpr("'t' AS trace_id", "CAST(id AS INT) AS unit", "id AS finish", "CAST(NULLIF(id, 0) - 1 AS INT) AS pred")
    ends = spark.createDataFrame([("t", n - 1)], "trace_id string, unit int")
    got = {r.unit: r.back for r in critical.walked_back(ends, known).collect()}
    assert got == {u: n - 1 - u for u in range(n)}


def test_rate_files_are_strict(spark, tmp_path):
    good = {"schema": rates.SCHEMA, "as_of": "2026-01-01", "currency": "USD", "rates": [{"provider": "b", "model": "m", "per_million_tokens": {"input": "2.5", "output": "10", "cache_read_input": "0.3"}}, {"provider": "a", "model": "m", "per_million_tokens": {"input": "1", "output": "2"}}]}

    def load(doc, tail=""):
        path = tmp_path / f"rates-{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(doc) + tail)
        return rates.load_rates(spark, str(path))

    book = load(good)
    assert [r.rate_key for r in book.keys().collect()] == ["a/m", "b/m"] and len(book.sha256) == 64 and book.currency == "USD"
    assert {r.provider: (str(r.input), r.cache_read and str(r.cache_read)) for r in book.rates.collect()} == {"b": ("2.500000000", "0.300000000"), "a": ("1.000000000", None)}
    entry = good["rates"][0]
    bad = [{"schema": "x"}, {"as_of": "yesterday"}, {"currency": " "}, {"rates": []}, {"more": 1}, {"rates": [entry, entry]}, {"rates": [entry | {"model": ""}]}]
    bad += [{"rates": [entry | {"per_million_tokens": x}]} for x in ({"input": "1"}, {"input": "-1", "output": "1"}, {"input": "1e3", "output": "1"}, {"input": "1", "output": "1", "other": "1"})]
    for change in bad:
        with pytest.raises(ValueError):
            load(good | change)
    with pytest.raises(ValueError):
        load(good, "{}")


def test_deep_trees_take_few_rounds(spark, monkeypatch):
    from spanloom.operators import tree

    names, plain = [], tree.materialize
    monkeypatch.setattr(tree, "materialize", lambda df, name: names.append(name) or plain(df, name))
    n = 300
    rows = [("t", f"s{k}", f"s{k - 1}" if k else None, k, k) for k in range(n)] + [("t", "side", "s150", 151, n), ("t", "lost", "nobody", 1, n + 1), ("u", "r", None, 1, 1)]
    frame = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, started_ns long, ord long")
    found = {(r.trace_id, r.span_id): (r.depth, list(r.chain)) for r in tree.assemble_tree(frame).collect()}
    assert found["t", "s299"] == (299, [f"s{k}" for k in range(300)]) and found["t", "side"][0] == 151 and found["u", "r"] == (0, ["r"])
    assert len(found) == n + 2 and len(names) <= 1 + tree.TOP_LEVELS + 10


def test_small_and_large_graphs_fare_alike(spark, monkeypatch):
    monkeypatch.setattr(critical, "PLAIN_PEELS", 1)
    rng, rows = random.Random(17), []
    for k in range(8):
        n = rng.randint(1, 9)
        for u in range(n):
            tokens = [str(rng.randint(u if k % 2 else 0, n)) for _ in range(rng.randint(0, 2))] + ["x"] * (rng.random() < 0.05)
            rows.append((f"g{k}", f"s{u}", u, rng.choice([0, 1, 2, 5, None]), str(u if rng.random() < 0.97 else u - 1), ",".join(tokens) or None))
        rows.append((f"g{k}", "plain", n, 3, None, None))
    df = spark.createDataFrame(rows, "trace_id string, span_id string, ord long, duration_ns long, unit_text string, unblocks_text string")
    found = []
    for most in (10_000, 6):  # of the second some take the joins
        monkeypatch.setattr(critical, "SMALL", most)
        found.append([sorted(map(str, x.collect())) for x in (*critical.critical_path(df), critical.critical_path_lenient(df))])
    assert found[0] == found[1] and all(found[0])


def test_traces_are_solved_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        graphs = {f"g{k}": ({u: u + 1 for u in range(k)}, [(u, u + 1) for u in range(k - 1)]) for k in range(1, 8)}
        report, path, issues = critical.critical_path(spans(spark, graphs))
        assert {r.trace_id: (r.status, r.critical_ns, r.path_count) for r in report.collect()} == {f"g{k}": ("ok", k * (k + 1) // 2, k) for k in range(1, 8)}
        assert issues.isEmpty() and path.count() == 28
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
