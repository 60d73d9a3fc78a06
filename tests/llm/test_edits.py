import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from spanloom.llm import edits

COUNT = edits.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TEXT = st.text(alphabet="ab c  \n1'sté漢.,! tll", max_size=120)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-2, 130), st.integers(-2, 140), st.text(alphabet="a '\n1é", max_size=8)), max_size=5))
def test_counts_equal_a_full_encoding(text, changes):
    doc = edits.EditedDocument(text, COUNT.split, COUNT)
    for start, stop, new in changes:
        a = min(max(start, 0), len(text))
        b = min(max(stop, a), len(text))
        text = text[:a] + new + text[b:]
        doc.edit(start, stop, new)
        assert doc.text == text
        assert doc.tokens == len(COUNT.encoding.encode_ordinary(text))
        assert list(edits.bounds(doc.tree)) == [m.start() for m in COUNT.split.finditer(text)]


def test_only_the_touched_region_is_read():
    doc = edits.EditedDocument("word " * 50_000, COUNT.split, COUNT)
    for k in range(200):
        doc.edit(1000 * k, 1000 * k + 3, "xy")
    assert doc.recounted < 200 * 40 and doc.tree.height < 20
    assert doc.tokens == len(COUNT.encoding.encode_ordinary(doc.text))


def test_edges(spark):
    rows = [(1, "hello world", "s"), (1, "hello world", "s"), (None, None, None), (2, "", "s"), (3, "q " * 100_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_edits", F.lit(1))
    got = edits.count_edits(docs, edits.routine_edits(F.col("text"), F.col("source"))).collect()
    assert len(got) == 5 and all(r.n_edits == 3 for r in got)
    for r, (_, text, source) in zip(sorted(got, key=lambda r: (r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] or 0))):
        assert r.n_tokens == len(COUNT.encoding.encode_ordinary(text or ""))
    same = edits.count_edits(docs, F.lit(None)).collect()
    assert all(r.n_tokens == r.n_tokens_edited and r.n_edits == 0 for r in same)
    assert edits.count_edits(docs.limit(0), F.lit(None)).count() == 0


def test_stored_trees_follow_edits(spark):
    full = lambda text: sum(COUNT(m) for m in COUNT.split.findall(text))
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(["alpha", "it's", "12,5", "\n\n", "été"]) for _ in range(rng.choice([0, 3, 40, 3000]))) for i in range(24)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, "gone", "x")], "doc_id long, text string, leaf string")
    grown = edits.grow_trees(docs)
    assert {r.id: r.n_tokens for r in grown.collect()} == {i: full(t) for i, t in texts.items()}
    stored = edits.leaf_rows(grown)
    schema = "id long, edits array<struct<start:long,stop:long,new:string>>"
    for turn in range(3):
        asked = {i: [(rng.randint(0, len(t)), None, "new word ") if turn else (len(t) // 2, len(t) // 2 + 5, "")] for i, t in texts.items() if i % 3 == turn % 3}
        done, stored = edits.edit_trees(docs, stored, spark.createDataFrame(list(asked.items()), schema))
        for i, ((start, stop, new),) in asked.items():
            texts[i] = texts[i][:start] + new + texts[i][start if stop is None else stop :]
        got = {r.id: r for r in done.collect()}
        assert set(got) == set(asked)
        for i, r in got.items():
            assert r.text == texts[i] and r.n_tokens == full(texts[i]) and r.n_chars_recounted <= 60
        held = {r.id: (r.chars, r.tokens) for r in stored.groupBy("id").agg(F.sum(F.aggregate("lengths", F.lit(0), lambda a, x: a + x)).alias("chars"), F.sum(F.aggregate("counts", F.lit(0), lambda a, x: a + x)).alias("tokens")).collect()}
        assert held == {i: (len(t), full(t)) for i, t in texts.items() if t}
        docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, leaf string")
    none = edits.edit_trees(docs, stored, spark.createDataFrame([], schema))
    assert none[0].count() == 0 and none[1].count() == stored.count()


def test_all_rows_of_edits_apply_in_order(spark):
    docs = spark.createDataFrame([(1, "hello world foo bar"), (2, "other")], "doc_id long, text string")
    stored = edits.leaf_rows(edits.grow_trees(docs))
    schema = "id long, edits array<struct<start:long,stop:long,new:string>>, at int"
    rows = [(1, [(0, 0, "B ")], 2), (1, [(0, 0, "A "), (0, 1, "a")], 1), (2, None, 1), (None, [(0, 0, "x")], 1)]
    asked = spark.createDataFrame(rows, schema)
    done, _ = edits.edit_trees(docs, stored, asked, order_col="at")
    assert {r.id: r.text for r in done.collect()} == {1: "B a hello world foo bar", 2: "other"}
    with pytest.raises(Exception, match="order column"):
        edits.edit_trees(docs, stored, asked.drop("at"))


def test_long_pretokens_are_not_remembered():
    count = edits.Counter(edits.public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert count("x" * 5000) > 1 and not count.known
    assert count("word") and count.known == {"word": 1}
