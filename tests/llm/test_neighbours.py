import itertools

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import neighbours


def test_visits_come_in_order_of_their_cost():
    hashes = neighbours.Hashes(5, 3, 2, 1.0, probes=27, coarse=1)
    vectors = np.random.default_rng(4).standard_normal((6, 5))
    bucket, cell, inside = hashes.cells(vectors)
    seen, where = hashes.visits(bucket[:, 1], cell[:, 1], inside[:, 1])
    for i in range(6):
        want = []
        for steps in itertools.product((-1, 0, 1), repeat=3):
            cost = sum(0 if s == 0 else inside[i, 1, j] ** 2 if s < 0 else (1 - inside[i, 1, j]) ** 2 for j, s in enumerate(steps))
            moved = [int(bucket[i, 1]) + sum(s * int(m) for s, m in zip(steps, hashes.mix)), int(cell[i, 1]) + steps[0] * int(hashes.cell_mix[0])]
            want.append((cost, *(x % 2**64 for x in moved)))
        assert list(zip(seen[i].tolist(), where[i].tolist())) == [(x, y) for _, x, y in sorted(want)]


def test_sets_of_crossings():
    for k, most in ((1, 100), (3, 100), (6, 300)):
        found = neighbours.moves(k, most)
        assert len(found) == min(most, 3**k) == len(np.unique(found, axis=0)) and not found[0].any()
        assert not (found & found[:, ::-1]).any()


def brute(vectors, queries):
    ids = np.array(sorted(vectors))
    v = np.array([vectors[i] for i in ids], np.float64)
    out = {}
    for q in queries:
        d = np.sqrt(((v - np.array(vectors[q], np.float64)) ** 2).sum(1))
        best = [(x, i) for x, i in zip(d, ids) if i != q]
        out[q] = sorted(best)[:10]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    data = rng.standard_normal((1500, 24)).astype(np.float32)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    data[100:400] = data[100]  # a hot vector
    rows = [(i, x.tolist(), 1) for i, x in enumerate(data)]
    vectors = {i: x.tolist() for i, x in enumerate(data)}
    bad = [(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [float("nan")] * 24, 1), (9004, [float("inf")] + [1.0] * 23, 1), (9005, [None] + [1.0] * 23, 1), (9006, [1.0], 1), (None, data[0].tolist(), 1), (9100, [], 1)]
    df = spark.createDataFrame(rows + bad + rows[:1], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute(vectors, [i for i in vectors if i % 50 == 0])
    assert set(got) == set(want)
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert found == sorted(found)
        for score, i in found:
            assert abs(score - float(np.linalg.norm(data[q].astype(float) - data[i].astype(float)))) < 1e-12
    hot = got[150]
    assert [i for _, i in hot] == list(range(100, 110)) and {s for s, _ in hot} == {0.0}


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert neighbours.search(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.search(df, F.col("vec_id") == 77).count() == 0


def test_repeated_rows_hide_nothing(spark):
    same = [(1, [1.0, 0.0])] * 12 + [(i, [1.0, 0.0]) for i in range(2, 21)]
    df = spark.createDataFrame(same, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in neighbours.search(df, F.col("vec_id") == 20).orderBy("rank").collect()]
    assert got == [(i, 0.0) for i in range(1, 11)]


def test_an_edge_counts_ids():
    import pyarrow as pa

    def ids(items, asks):
        side = lambda rows: [[{"id": i, "vector": np.array(x, "<f8").tobytes()} for i, x in rows]]
        kind = pa.list_(pa.struct([("id", pa.int64()), ("vector", pa.binary())]))
        batch = pa.RecordBatch.from_arrays([pa.array(side(items), kind), pa.array(side(asks), kind)], ["items", "asks"])
        return [x for out in neighbours._compare("<f8", 10)(iter([batch])) for x in out.column("vec_id").to_pylist()]

    line = [(i, [float(i), 1.0]) for i in range(1, 31)]
    assert sorted(ids([line[0]] * 12 + line[1:], [(99, [0.0, 1.0])])) == list(range(1, 11))
    assert sorted(ids(line * 2, [(99, [0.0, 1.0])])) == list(range(1, 11))
    # ids with two vectors each
    assert sorted(ids([x for i, v in line for x in ((i, v), (i, [v[0] + 0.1, 1.0]))], [(99, [0.0, 1.0])])) == list(range(1, 11))


def test_doubled_table(spark):
    rng = np.random.default_rng(5)
    data = rng.standard_normal((120, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(data)]
    df = spark.createDataFrame(rows * 2, "vec_id long, embedding array<double>")
    want = brute(dict(rows), [0, 60])
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 60 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(got[q]) == 10 and len(set(got[q]) & {i for _, i in want[q]}) >= 9 for q in want)


def measured(vectors, queries, count=None):
    """Recall over all `queries` of the hashes fitted on 40 of them."""
    square = (vectors[queries] ** 2).sum(1)[:, None] + (vectors**2).sum(1) - 2 * vectors[queries] @ vectors.T
    square[np.arange(len(queries)), queries] = np.inf
    near = np.argsort(square, axis=1)[:, :10]
    owner = np.repeat(np.arange(len(queries)), 10)
    few = owner < 40
    reach = np.quantile(np.sqrt(np.take_along_axis(square, near, 1)[:40, 9]), 0.9)
    h = neighbours.fit(vectors[queries[:40]], vectors[near.ravel()[few]], owner[few], reach, vectors[:1000], count or len(vectors))
    assert h.tables <= neighbours.MOST_TABLES and h.recall >= neighbours.TARGET
    return h, neighbours._held(h, vectors[queries], vectors[near.ravel()], owner).any(axis=1).mean()


def test_recall_is_measured():
    rng = np.random.default_rng(3)
    sphere = rng.standard_normal((6000, 32))
    sphere /= np.linalg.norm(sphere, axis=1, keepdims=True)
    # clusters of unequal size and density
    sizes = [3000, 2000, 700, 250, 50]
    clusters = np.concatenate([rng.standard_normal(32) * 8 + rng.standard_normal((n, 32)) * 0.1 * 3**i for i, n in enumerate(sizes)])
    for data in (sphere, rng.permutation(clusters)):
        # no matter how many vectors the sample stands for
        for count in (6000, 10**6, 10**12):
            _, recall = measured(data, np.arange(0, 6000, 30), count)
            assert recall >= 0.9


def test_cells_stay_small():
    data = np.random.default_rng(8).standard_normal((3000, 16))
    h, _ = measured(data, np.arange(0, 3000, 50), 10**6)
    _, held = np.unique(h.cells(data)[1][:, 0], return_counts=True)
    assert h.coarse == h.k or 10**6 * ((held / 3000) ** 2).sum() <= 2 * neighbours.CELL


def test_outliers_find_their_neighbours(spark):
    rng = np.random.default_rng(11)
    data = rng.standard_normal((2000, 16))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    data[:5] *= np.array([30, 300, 3000, 5, 1e5])[:, None]
    rows = [(i, x.tolist()) for i, x in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") < 8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute(dict(rows), range(8))
    assert {q: len(x) for q, x in got.items()} == dict.fromkeys(range(8), 10)
    for q in (0, 1, 2, 4):
        assert got[q] == [(n + 1, i) for n, (_, i) in enumerate(want[q])]


def test_few_candidates_are_all_found(spark):
    rows = [(i, [1.0 + i / 10, 1.0]) for i in range(7)] + [(7, [1e6, 1.0]), (8, [-1e9, 1e7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(df, F.col("vec_id") >= 0).collect()
    assert {q: sum(r.query_id == q for r in found) for q in range(9)} == dict.fromkeys(range(9), 8)


def test_unequal_clusters(spark):
    rng = np.random.default_rng(21)
    sizes = [900, 400, 150, 40, 6]
    data = np.concatenate([rng.standard_normal(12) * 5 + rng.standard_normal((n, 12)) * 0.05 * 4**i for i, n in enumerate(sizes)])
    rows = [(i, x.tolist()) for i, x in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(dict(rows), range(0, len(rows), 20))
    assert set(got) == set(want) and {len(x) for x in got.values()} == {10}
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_many_lists_meet_all_queries(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("LISTS", 2), ("CELL", 40)):
        monkeypatch.setattr(neighbours, name, value)
    data = np.random.default_rng(6).standard_normal((600, 6))
    rows = [(i, x.tolist()) for i, x in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asks = index.where("id % 10 = 0")
    want = brute(dict(rows), range(0, 600, 10))
    for found in (neighbours._whole(index, asks, 60, "<f8", 10), neighbours._hashed(index, asks, neighbours.Hashes(6, 4, 2, 1e3, coarse=2), "<f8", 10)):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == {q: [i for _, i in x] for q, x in want.items()}
