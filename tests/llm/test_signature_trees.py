import random
import re
from itertools import combinations

import numpy as np
import pytest

from spanloom.llm import signature_trees as trees

from .test_dedup import family


def sets_of(rows):
    out = {}
    for doc, text in rows:
        if doc is not None:
            low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
            w = re.findall(r"[^\x20\x09-\x0D]+", low)
            out[doc] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    return out


def joined(sets, percent=85):
    """The smallest key reachable, for every key."""
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            top[q] = p
    return {d: find(d) for d in sets}


def made(rng):
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(50)]
    rows = []
    for k in range(6):
        base = [rng.choice(words) for _ in range(rng.choice((12, 30, 80, 150)))]
        rows += family(rng, base, 30, 1000 * k, 6)
    for i in range(90):  # unrelated texts around one passage
        own = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        at = rng.randrange(len(own))
        rows.append((9000 + i, " ".join(own[:at] + passage + own[at:])))
    # a chain: each is like the next alone
    chain = [rng.choice(words) for _ in range(400)]
    rows += [(8000 + i, " ".join(chain[4 * i : 4 * i + 110])) for i in range(60)]
    rows += [(9500, "Short one"), (9501, "short ONE"), (9502, "short"), (9503, ""), (9504, None), (9505, " \n "), (9506, "a b c d"), (9507, "a b c d")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [trees.BLOCK, 25])
def test_components_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK", block)
    rows = made(random.Random(7))
    sets = sets_of(rows)
    want = joined(sets)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in trees.linked(docs).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}


@pytest.mark.parametrize("hot", [np.empty(0, np.uint64), "some"])
def test_first_tokens_meet(hot):
    rng = np.random.default_rng(2)
    order = rng.permutation(1000) if isinstance(hot, str) else np.arange(1000)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = set(rng.choice(1000, n, replace=False).tolist())
        y = set(list(x)[int(rng.integers(0, 1 + n // 6)) :]) | set(rng.choice(1000, int(rng.integers(0, 1 + n // 6))).tolist())
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            first = [set(sorted(s, key=lambda t: order[t])[: trees.first_tokens(len(s), 85)]) for s in (x, y)]
            assert first[0] & first[1]


@pytest.mark.parametrize("percent", [85, 60])
@pytest.mark.parametrize("split", [0, 130])
def test_traversal_joins_everything_that_links(percent, split):
    rng = np.random.default_rng(1)
    bases = [np.unique(rng.integers(0, 2**63, size).astype(np.uint64)) for size in (40, 100, 100, 900)]
    sets = []
    for k in range(300):
        s = bases[k % 4].copy()
        n = rng.integers(0, len(s) // 7)
        s[rng.choice(len(s), n, replace=False)] = rng.integers(0, 2**63, n)
        sets.append(np.unique(s))
    sets += [np.unique(rng.integers(0, 2**63, 50).astype(np.uint64)) for _ in range(40)]
    join = trees.Join(sets, list(range(len(sets))), percent, split)
    links = join.found()
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        assert find(a) != find(b)
        top[find(b)] = find(a)
    for a, b in combinations(range(len(sets)), 2):
        if split and (a < split) == (b < split):
            continue
        i = len(np.intersect1d(sets[a], sets[b]))
        if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            assert find(a) == find(b)


def test_nodes_are_pruned_and_bounds_hold():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, 100).astype(np.uint64)) for _ in range(640)]
    join = trees.Join(sets, list(range(640)), 85)
    assert join.found() == [] and join.looked < 640 * 639 // 2 // 8
    one, two = sets[0], np.unique(np.concatenate((sets[0][:60], sets[1][:40])))
    for bits in (64, 256, 4096):
        level = [trees.Tree(trees.bitmaps([x], bits), np.array([len(x)]), 0).levels[0] for x in (one, two)]
        shared = len(np.intersect1d(one, two))
        least = int(np.bitwise_count(level[0][0] & level[1][0]).sum() + min(level[0][3][0], level[1][3][0]))
        assert least >= shared


def test_the_sieve_keeps_all_that_links():
    rng = np.random.default_rng(6)
    sets = []
    for size in (3, 12, 60, 120, 125, 130, 900, 1020, 1030):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        for k in range(12):
            s = base.copy()
            n = int(rng.integers(0, 1 + size // 8))
            s[rng.choice(size, n, replace=False)] = rng.integers(0, 2**63, n)
            sets.append(np.unique(np.concatenate((s, rng.integers(0, 2**63, n % 4).astype(np.uint64)))))
    sets += [np.unique(rng.integers(0, 2**63, int(rng.integers(1, 2000))).astype(np.uint64)) for _ in range(200)]
    order = rng.permutation(len(sets))
    sets = [sets[k] for k in order]
    keep = trees.sieved(np.array([len(x) for x in sets]), [trees.bitmaps([x], trees.width_of(len(x)))[0].tobytes() for x in sets], 85)
    linked = set()
    for a, b in combinations(range(len(sets)), 2):
        i = len(np.intersect1d(sets[a], sets[b]))
        if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
            linked |= {a, b}
    assert linked <= set(np.flatnonzero(keep)) and keep.sum() < len(linked) + 60


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(None, long, 1), (3, long, 2), (3, long, 2), (2, long + " end", 3), (5, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted((r.doc_id or -1, r.component_id) for r in trees.linked(docs).collect())
    assert got == [(-1, None), (2, 2), (3, 2), (3, 2), (5, 5)]
    assert trees.linked(docs.limit(0)).count() == 0


def test_frequent_tokens_go_last(spark, monkeypatch):
    monkeypatch.setattr(trees, "HOT", 10)
    rows = made(random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert len(trees.hot_tokens(docs.select("text")))
    sets = sets_of(rows)
    assert {r.doc_id: r.component_id for r in trees.linked(docs).collect()} == joined(sets)
    monkeypatch.setattr(trees, "MOST_HOT", 5)
    assert len(trees.hot_tokens(docs.select("text"))) <= 5
