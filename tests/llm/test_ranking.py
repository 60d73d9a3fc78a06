import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import ranking


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    held = [(doc, Counter(words(text))) for doc, text in docs]
    lengths = [sum(c.values()) for _, c in held]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, c), size in zip(held, lengths):
            m = 100 - 75 + (75 * size * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out)


def made(rng, n, vocabulary):
    return [" ".join(vocabulary[min(int(rng.expovariate(0.08)), len(vocabulary) - 1)] + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(1, 80))) for _ in range(n)]


@pytest.mark.parametrize("part", [ranking.PART, 37])
def test_equals_brute_force(spark, part, monkeypatch):
    monkeypatch.setattr(ranking, "STEP", 4)
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünder", "日本", "x-y", "ABC", "abc"]
    docs = list(enumerate(made(rng, 400, vocabulary)))
    docs += [(1000 + k, docs[k % 7][1]) for k in range(60)]  # ties
    docs += [(2000, None), (2001, ""), (2002, " .,;\n"), (2003, "W1 w1\tW1")]
    items = list(enumerate(made(rng, 25, vocabulary))) + [(90, "nowhere at all"), (91, None), (92, "w1 w1 w2"), (93, "!")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = ranking.search(frame, spark.createDataFrame(items, "item_id long, text string"), part=part)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute(docs, items)


def test_reading_stops_early():
    rng = np.random.default_rng(5)
    n = 20_000
    doc = np.concatenate([rng.permutation(n) for _ in range(3)])
    base = rng.zipf(1.3, n).clip(1, 10**6) * 1000  # the same documents are high in all lists
    impact = (base[doc] * rng.uniform(0.9, 1.1, 3 * n)).astype(np.int64)
    index = ranking.Index(list(range(n)), doc, np.repeat(np.arange(3), n), impact, 3)
    item = ranking.Item(np.arange(3), np.array([7, 5, 3]))
    read = index.search(item, 10)
    score = np.zeros(n, np.int64)
    np.add.at(score, doc, impact * np.repeat([7, 5, 3], n))
    assert [(-s, d) for s, _, d in item.best] == sorted(((s, d) for d, s in enumerate(score.tolist())), key=lambda x: (-x[0], x[1]))[:10]
    assert read < n // 2


def test_ties_beyond_the_last_rank_are_resolved_by_id():
    n = 500
    index = ranking.Index(list(range(n))[::-1], np.arange(n), np.zeros(n, np.int64), np.full(n, 9), 1)
    item = ranking.Item(np.array([0]), np.array([2]))
    index.search(item, 3)
    assert item.best == [(-18, False, 0), (-18, False, 1), (-18, False, 2)]


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (3, "a b", 2), (3, "a b", 2), (4, "c", 0)], "doc_id long, text string, rank int")
    items = spark.createDataFrame([(1, "b", 5), (1, "b", 6), (None, "c", 7)], "item_id long, text string, score int")
    got = sorted((r.item_id or -1, r.rank, r.doc_id) for r in ranking.search(docs, items).collect())
    assert got == [(-1, 1, 4), (1, 1, 3), (1, 2, 3), (1, 3, None)]
    assert ranking.search(docs.limit(0), items).count() == 0 and ranking.search(docs, items.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "many " * 200_000 + "rare"), (2, "rare")], "doc_id long, text string")
    got = ranking.search(long, spark.createDataFrame([(0, "rare")], "item_id long, text string")).collect()
    assert [(r.doc_id, r.rank) for r in got] == [(2, 1), (1, 2)]


def test_items_in_blocks(spark, monkeypatch):
    docs = [(k, f"t{k % 5} t{k % 3} all") for k in range(40)]
    items = [(k, f"t{k} all") for k in range(12)]
    monkeypatch.setattr(ranking, "BLOCK_ITEMS", 4)
    found = ranking.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == brute(docs, items)


def test_lengths_of_any_size():
    n = np.array([10**9, 3], np.int64)
    assert ranking.lengths(n, 10**12, 10**13).tolist() == [25 + 75 * x * 10**12 // 10**13 for x in n.tolist()]
    assert ranking.terms(pa.array(["a", None, "b-B"]))[1].tolist() == [0, 1, 1, 3]
