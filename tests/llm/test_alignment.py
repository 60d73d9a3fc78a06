import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from spanloom.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def units():
    return alignment.Units(*PATHS)


def plain(units, text):
    """Groups of a text: both tokenizers over the whole of it, offsets compared one by one."""
    if not text:
        return []
    a, b = units.a.encode(" " + text, add_special_tokens=False).ids, units.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(units.a_bytes[i] for i in a) != whole or b"".join(units.b_bytes[i] for i in b) != whole:
        return []
    groups, x, y, i, j, k, m = [], 0, 0, 0, 0, 0, 0
    while k < len(a) or m < len(b):
        if x <= y:
            x, k = x + len(units.a_bytes[a[k]]), k + 1
        else:
            y, m = y + len(units.b_bytes[b[m]]), m + 1
        if x == y:
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
    return groups


def brute(units, rows):
    groups = [plain(units, text) for _, text in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    docs = Counter(p for x in links for p in x)
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for (doc, _), g, own in zip(rows, groups, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        best = sum(n for (a, b), n in own.items() if docs[a, b] == most[a])
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), best, sum(n * docs[p] for p, n in own.items()), digest))
    return out


def texts():
    rng = random.Random(3)
    parts = ["word", "Hello", "don't", "año", "naïve", "über", "１２", "12345", "日本語テキスト", "🙂🙂", "é", "<s>", "<|endoftext|>", " ", "　", " ", "x" * 40, "ﬁne", "\u0085", "....", "--", "\x1c"]
    gaps = [" ", " ", " ", "  ", "\n", "\n\n", "\t", " \n ", "   ", "\r\n", ""]
    out = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randrange(1, 60))) for _ in range(250)]
    out += [None, "", " ", "  lead", "trail ", "\nnew", "a▁b", "same text", "same text", "▁", "\x00", "a  b", "  é", "é é é"]
    long = " ".join(rng.choice(parts[:10]) for _ in range(3000))
    return [*out, long, "z" * 5000 + " " + long[:3000], "日本語" * 2000]


def got(frame):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(tuple(r[x] for x in names) for r in frame.collect())


@pytest.mark.parametrize("chunk", [alignment.CHUNK, 300])
def test_equals_whole_encoding(spark, units, chunk):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(alignment.align(docs, chunk=chunk)) == sorted(brute(units, rows))


def test_real_texts_in_blocks_of_pairs(spark, units, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = alignment.aligned(docs, chunk=2000)
    counts = alignment.pair_counts(found)
    split = alignment.weighed(found, counts, block_pairs=1 + counts.count() // 3).withColumnRenamed("id", "doc_id")
    assert got(split) == sorted(brute(units, rows))


def test_fragments_are_a_monoid(units):
    rng = random.Random(9)
    text = ("naïve über 日本語 テキスト égalité " + "x" * 60 + " 12345 ") * 4
    stretch = (" " + text).encode()
    whole, *_ = alignment.encoded(units, stretch, 0, 0, len(stretch))
    same = lambda x, y: all(np.array_equal(p, q) if isinstance(p, np.ndarray) else p == q for p, q in zip(x, y))
    for _ in range(60):
        bounds = [0, *sorted(rng.sample(range(1, len(stretch)), rng.randrange(1, 40))), len(stretch)]
        parts = [alignment.encoded(units, stretch, 0, lo, hi)[0] for lo, hi in zip(bounds, bounds[1:])]
        while len(parts) > 1:  # any order of composition
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [alignment.compose(parts[k], parts[k + 1])]
        assert same(parts[0], whole)
        assert same(alignment.compose(alignment.EMPTY, whole), whole) and same(alignment.compose(whole, alignment.EMPTY), whole)


def test_ranges_cover_once_and_stay_in_bounds():
    starts = np.array([0, 10, 12, 400, 410])
    found = alignment.ranges(500, starts, 50)
    assert [x[0] for x in found] == [0, 50, 400, 450]  # 100 to 350 lie in the unit of 50
    assert all(x <= lo and y >= hi for lo, hi, x, y in found)
    assert [a[1] for a in found[:-1]] == [b[0] for b in found[1:]] and found[-1][1] == 500


def test_edges(spark, units, monkeypatch):
    rows = [(None, "a b", "q"), (7, "a b", None), (7, "a b", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string")
    found = alignment.align(docs).collect()
    assert [r.n_a for r in found] == [2, 2, 2] and {r.count_sum for r in found} == {6} and len({r.groups for r in found}) == 1
    assert sorted(found[0].asDict()) == sorted(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"])
    assert alignment.align(docs.limit(0)).count() == 0
    monkeypatch.setattr(alignment, "CACHE_BYTES", 1000)
    alignment._UNITS[PATHS] = units
    units.forget()
    units.codes(alignment._binary(np.frombuffer(b" ab" * 9, np.uint8), np.arange(0, 27, 3)))
    units.bytes = 2000
    assert not alignment.units_of(PATHS).known
