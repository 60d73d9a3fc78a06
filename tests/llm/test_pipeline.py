import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import packing

PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
SYLLABLES = {"en": ["the", "and", "ing", "wh", "ough", "ly", "th", "er"], "es": ["ción", "que", "los", "ñar", "ado", "ía", "el", "ll"]}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, kept int, offset int, part int"


def prose(seed, lang, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def made():
    """Documents, and what becomes of each: the text that is packed, or None if it goes."""
    rows, want = [], {}

    def add(doc_id, text, lang, kept):
        rows.append((doc_id, text, lang, "s", 1, "r", "i", 0, 0, 0))
        want[doc_id] = kept

    for i in range(60):
        lang = "en" if i % 2 else "es"
        text = prose(i, lang, 90 + i)
        add(i, text, lang, text)
        if i % 10 == 0:
            add(1000 + i, text, lang, None)  # an exact copy
        if i % 10 == 1:
            add(2000 + i, text + " more words at its end", None, None)  # a near copy
    text = prose(500, "en", 80)
    add(500, text + " mail joe@example.org now", "en", text + " mail <email> now")
    add(501, prose(501, "es", 20), "es", None)  # few words
    add(502, None, "en", None)
    add(503, "", None, None)
    add(504, "12345 67890 " * 60, "en", None)  # no letter
    long = prose(505, "en", 60_000)
    add(505, long, "en", long)
    rows.append(rows[0])  # a repeated row
    return rows, want


def packed_texts(sequences):
    found = {}
    for r in sequences:
        for p in r.pieces:
            found.setdefault(p.doc_id, []).append((p.start, r.ids[p.offset : p.offset + p.length]))
    return found


def test_the_pipeline_equals_what_was_planned(spark, made, tmp_path):
    rows, want = made
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = packed_texts(corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert set(found) == {d for d, text in want.items() if text is not None}
    for d, pieces in found.items():
        ids = [*PLAIN.encode(want[d], add_special_tokens=False).ids, packing.END_ID]
        whole = [i for _, part in sorted(pieces) for i in part]
        assert whole == ids or d == 0 and sorted(whole) == sorted(ids * 2)
    assert len([1 for start, _ in found[0] if start == 0]) == 2


def test_stages_return_their_columns_and_take_empty_tables(spark, made):
    rows, _ = made
    none = spark.createDataFrame([], COLUMNS)
    few = spark.createDataFrame([(None, None, None, None, None, None, None, None, None, None), (1, "", None, None, None, "x", "y", 1, 2, 3)] * 2, COLUMNS)
    stays = {"language id": 0, "quality rules": 0, "near duplicates": 4, "personal data": 4}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs, n in ((none, 0), (few, stays[name])):
            got = stage(spark, docs, "")
            assert got.schema.simpleString() == docs.schema.simpleString() and got.count() == n, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, none, "").count() == 0
    (row,) = last(spark, few, "").collect()
    assert row.used == 4 and np.array_equal(row.ids[:4], [packing.END_ID] * 4)
