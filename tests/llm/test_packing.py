import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


_SPECIAL = st.sampled_from(["<|ENDOFTEXT|>", "<|endoftext|>", "<|StartOfText|>", "<|startoftext|>", "</w>"])
_TEXT = st.lists(st.one_of(st.text(alphabet="aAbBéÉßẞ.,!'st\t\nİΣσ#*1١é<|>_-ñ \x1c漢", max_size=30), _SPECIAL), max_size=4).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), _TEXT), max_size=4))
def test_word_ids_equal_the_tokenizer(texts):
    ids, at = packing.encoder(PATH).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*ids_of(x), packing.END_ID] for x in texts]


def test_long_texts_go_in_stretches(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 50)
    monkeypatch.setattr(packing, "GATHER", 7)
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    encode = packing.WordIds(PATH)
    rng = np.random.default_rng(1)
    for _ in range(5):
        texts = [" ".join(f"word{x}," for x in rng.integers(0, 60, n)) for n in (0, 3, 200, 1)] + ["x" * 300]
        ids, at = encode.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*ids_of(x), packing.END_ID] for x in texts]


def test_pieces_and_sequences(spark):
    rows = [(i, "lorem ipsum dolor sit amet " * (1 + i * 37 % 700), "x") for i in range(300)]
    rows += [(None, "null id", "y"), (7, None, "z"), (8, "", "z"), (9, "repeat", "z"), (9, "repeat", "z"), (10, "zq" * 40_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string").repartition(3)
    got = packing.pack(docs, windows=8).toPandas()
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(-1 if d is None else d, []).append(np.array([*ids_of(t), 1], "<u4"))
    for r in got.itertuples():
        d = -1 if r.doc_id is None or r.doc_id != r.doc_id else int(r.doc_id)
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in texts[d])
    assert got.length.sum() == sum(len(x) for own in texts.values() for x in own)
    seq = got.sort_values(["sequence_id", "offset"])
    assert (seq.groupby("sequence_id").length.cumsum() - seq.length == seq.offset).all()
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= packing.LENGTH and (used.sum() / len(used)) > 0.9 * packing.LENGTH
    assert packing.pack(docs.limit(0)).count() == 0


def test_open_windows_take_the_best_fit():
    state = packing.OpenWindows(2, 10)
    for name, size in (("a", 6), ("b", 7), ("c", 3), ("d", 8), ("e", 4)):
        state.place(name, size)
    # c fills b's window; d opens a third, so none is emitted; e fills a's window
    assert [[x for x, _ in items] for _, items in state.closed] == [["b", "c"], ["a", "e"]]
    state.place("f", 9)
    state.place("g", 5)
    assert [[x for x, _ in items] for _, items in state.closed][2:] == [["f"]]


def test_ids_and_padded_sequences(spark):
    rows = [(i, "lorem ipsum dolor sit amet " * (1 + i * 37 % 900)) for i in range(200)] + [(500, None), (501, "zq" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {d: [*ids_of(t), packing.END_ID] for d, t in rows}
    for r in packing.pack(docs, windows=8).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id][r.start : r.start + r.length]
    found = {d: {} for d in want}
    made = packing.sequences(docs, windows=8).collect()
    assert len({r.sequence_id for r in made}) == len(made)
    for r in made:
        assert len(r.ids) == packing.LENGTH and set(r.ids[r.used :]) <= {packing.PAD_ID}
        at = 0
        for p in r.pieces:
            assert p.offset == at
            at += p.length
            found[p.doc_id][p.start] = r.ids[p.offset : p.offset + p.length]
        assert at == r.used
    assert {d: [i for _, x in sorted(own.items()) for i in x] for d, own in found.items()} == want
    assert any(len(r.pieces) > 1 and r.sequence_id % 2 == 0 for r in made)
    assert packing.sequences(docs.limit(0)).count() == 0


def test_pipeline_ends_in_sequences(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    (row,) = dict(corpus_pipeline.STAGES)["packing"](spark, docs, "").collect()
    assert row.ids[: row.used] in ([*ids_of("a b c"), 1, *ids_of("d e"), 1], [*ids_of("d e"), 1, *ids_of("a b c"), 1])


def test_a_full_stretch_closes_no_open_window():
    state = packing.OpenWindows(2, 10)
    for name, size in (("a", 6), ("b", 7), ("full", 10), ("c", 4), ("d", 3)):
        state.place(name, size)
    assert [[x for x, _ in items] for _, items in state.closed] == [["full"], ["a", "c"], ["b", "d"]]
    numbers = [k for k, _ in state.closed]
    assert len(set(numbers)) == 3 and not state.items


def test_the_cache_of_words_is_bounded_in_bytes(monkeypatch):
    found = packing.WordIds(packing.public_tokenizers.path("word_bpe_49k.json"))
    long = pa.array(["x" * 3000 + str(k) for k in range(20)])
    one = found.encode(long)
    assert set(found.known) == {""} and found.bytes == 0
    monkeypatch.setattr(packing, "CACHE_BYTES", 10)
    again = found.encode(long)
    assert all((x == y).all() for x, y in zip(one, again)) and len(found.at) == 21
