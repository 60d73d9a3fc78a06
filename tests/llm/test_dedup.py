import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from spanloom.llm import dedup


def brute(rows):
    """component by doc_id, all pairs compared."""
    sets = {}
    for doc, text in rows:
        if doc is None:
            continue
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets[doc] = s
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            p, q = sorted((find(a), find(b)))
            top[q] = p
    return {d: (len(sets[d]), find(d)) for d in sets}


def family(rng, base, n, start, edits):
    """Near copies of one text with a growing number of changed words."""
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append((start + i, " ".join(words)))
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for k in range(6):
        base = [rng.choice(words) for _ in range(rng.choice((30, 80, 150)))]
        rows += family(rng, base, 25, 1000 * k, 6)
    rows += [(9000 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    rows += [(9100, "Short one"), (9101, "short ONE"), (9102, "short"), (9103, ""), (9104, None), (9105, " \n ")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(docs).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in dedup.representatives(docs).collect()}
    assert kept == {c for _, c in got.values()}


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(None, long, 1), (3, long, 2), (3, long, 2), (2, long + " end", 3), (5, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in dedup.near_duplicates(docs).collect())
    assert got == [(-1, None, True), (2, 2, True), (3, 2, False), (3, 2, False), (5, 5, True)]
    assert dedup.representatives(docs).columns == docs.columns
    assert dedup.near_duplicates(docs.limit(0)).count() == 0


def test_forest_joins_everything_that_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = []
    for _ in range(700):
        s = base.copy()
        k = rng.integers(0, 12)
        s[rng.choice(100, k, replace=False)] = rng.integers(0, 2**63, k)
        sets.append(np.unique(s))
    nodes = list(range(700))
    found = dedup.forest(nodes, nodes, sets)
    top = nodes.copy()

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in found:
        assert find(a) != find(b)
        top[find(b)] = find(a)
    for a, b in combinations(range(700), 2):
        i = len(np.intersect1d(sets[a], sets[b]))
        if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
            assert find(a) == find(b)


def test_signatures_estimate_similarity():
    a = " ".join(f"a{i}" for i in range(400))
    b = " ".join(f"a{i}" for i in range(40, 440))
    values, at = dedup.shingle_sets(pa.array([a, b]))
    sig = dedup.signatures(values, at)
    x, y = (set(values[at[i] : at[i + 1]].tolist()) for i in (0, 1))
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.1


def test_threshold_is_a_parameter(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(104)]
    # one word in the middle changed: 95 of 100 shingles are common, 95 of 105 in all; two: 90 of 110, 0.818
    two = [x if i not in (30, 60) else "other" for i, x in enumerate(words)]
    far = [x if i not in (20, 40, 60) else "third" for i, x in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(two)), (3, " ".join(far))], "doc_id long, text string")
    kept = lambda found: sorted(r.doc_id for r in found.collect())
    assert kept(dedup.representatives(docs)) == [1, 2, 3]
    assert kept(dedup.representatives(docs, percent=80)) == [1, 3]
    assert kept(dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, "")) == [1, 3]


def test_links_across_blocks_keep_the_threshold():
    sets = [np.arange(100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64)]  # 90 of 110
    assert dedup.forest([1, 2], [1, 2], sets) == [] and dedup.forest([1, 2], [1, 2], sets, 80) == [(1, 2)]
