import zlib
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import sharding


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 3)])
def test_curve_visits_every_cell_and_moves_one_step(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law):
    rows = [(i, "t" * (i * 7 % 90), ["en", "de"][i % 2], f"s{i % 5}", i) for i in range(503)]
    rows += [(None, None, None, None, 1), (4, "é", "fr", "s0", 2), (4, "é", "fr", "s0", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    got = sharding.hilbert_shards(docs, law=law).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {law}
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(40))
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 40
    else:
        size = Counter()
        for r in got:
            size[r.shard] += r["size"]
        assert max(size.values()) - min(size.values()) <= 2 * 106
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)
    assert sharding.hilbert_shards(docs.limit(0), law=law).count() == 0


def test_long_common_prefixes_fall_apart(spark):
    rows = [(i, "t", "en", f"https://archive.example.org/crawl-2023-{i % 50:02d}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cuts = sharding.string_cuts(docs, "source")
    assert len(cuts) == 49 and list(cuts) == sorted({r[3] for r in rows})[1:]
    got = {r.doc_id: r.curve for r in sharding.hilbert_shards(docs).collect()}
    assert len(set(got.values())) == 50


def test_cuts_hold_equal_shares(spark):
    rows = [(f"s{i:05d}" if i % 3 else "hot",) for i in range(6000)] + [("",)] * 10
    cuts = list(sharding.string_cuts(spark.createDataFrame(rows, "v string"), "v"))
    held = np.bincount(np.searchsorted(np.array(cuts, object), np.array([r[0] for r in rows], object), "right"))
    assert cuts == sorted(set(cuts)) and sorted(held)[-1] >= 2000 and sorted(held)[-2] <= 2 * 6010 / 64


def test_long_texts_and_files(spark, tmp_path):
    rows = [(i, "x" * (10**6 if i == 3 else i), ["en", None][i % 2], f"s{i % 3}", i) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot int")
    bounds = {r.shard: r for r in sharding.write_shards(docs, str(tmp_path / "out"), shards=7).collect()}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r)[:5] for r in back.select(*docs.columns).collect()) == sorted(rows)
    where = {r.doc_id: r.shard for r in sharding.hilbert_shards(docs, shards=7).collect()}
    for r in back.collect():
        own = bounds[r["_shard"]]
        assert where[r.doc_id] == r["_shard"] and own.min_size <= len(r.text) + 16 <= own.max_size
        assert own.min_source <= r.source <= own.max_source and own.min_lang <= (r.lang or "") <= own.max_lang
    assert sum(r.rows for r in bounds.values()) == 90


def test_fewer_rows_than_shards(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s"), (2, "b", "en", "s")], "doc_id long, text string, lang string, source string")
    got = sharding.hilbert_shards(docs).collect()
    assert sorted(r.slot for r in got) == [0, 0] and len({r.shard for r in got}) == 2
