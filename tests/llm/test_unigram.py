import math
import random
from array import array

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = unigram.model(PATH)
IDS = {name.encode(): i for i, name in enumerate(unigram.pieces(PATH)[0]) if MODEL.scores[i] is not None}
LONGEST = max(map(len, IDS))


def best_score(text):
    """The best sum of scores over all segmentations of the whole text, without cuts or a trie."""
    data = (unigram.MARK + text.replace(" ", unigram.MARK)).encode()
    best = [0.0] + [-math.inf] * len(data)
    at = 0
    for char in data.decode():
        size = len(char.encode())
        best[at + size] = max(best[at + size], best[at] + size * MODEL.byte_score)
        for end in range(at + 1, min(len(data), at + LONGEST) + 1):
            if (i := IDS.get(data[at:end])) is not None:
                best[end] = max(best[end], best[at] + MODEL.scores[i])
        at += size
    return best[-1]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcdtheing  é漢\n.,ñ\U0001f600", min_size=1, max_size=40))
def test_best_segmentation(text):
    ids = array("I", MODEL.encode(text))
    got = sum(MODEL.byte_score if MODEL.scores[i] is None else MODEL.scores[i] for i in ids)
    assert abs(got - best_score(text)) < 1e-9


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=40))
def test_round_trip(text):
    assert MODEL.decode(MODEL.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \u2581\ue000\ue001ab\n漢", max_size=20))
def test_marks_and_private_characters(text):
    assert MODEL.decode(MODEL.encode(text)) == text


def test_marks_of_the_text_survive():
    for text in ("▁", "a▁b", "▁▁ x ▁", " ▁", "  ", " a", "a ", "\x00", "<s> </s>", "<0x41>"):
        assert MODEL.decode(MODEL.encode(text)) == text


def test_trie_holds_its_keys_and_nothing_else():
    rng = random.Random(1)
    keys = {bytes(rng.choices(range(256), k=rng.randint(1, 4))): i for i in range(3000)}
    trie = unigram.DoubleArray(keys)

    def get(key):
        node = 0
        for byte in key:
            child = trie.base[node] + byte + 1
            if trie.check[child] != node:
                return -1
            node = child
        return trie.value[node]

    assert all(get(k) == v for k, v in keys.items())
    for _ in range(3000):
        key = bytes(rng.choices(range(256), k=rng.randint(1, 4)))
        assert get(key) == keys.get(key, -1)


def test_edges(spark):
    rows = [(1, "hello world", 1), (1, "hello world", 1), (None, None, 2), (2, "", 3), (3, "x" * 200_000 + " y", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = unigram.encode(docs)
    got = out.collect()
    assert len(got) == 5 and all(r.round_trip for r in got)
    assert [r.n_pieces for r in got if r.doc_id is None or r.doc_id == 2] == [0, 0]
    back = {r.doc_id: r.text for r in unigram.decode(out).collect()}
    assert back[3] == rows[-1][1] and back[2] == ""
    assert unigram.encode(docs.limit(0)).count() == 0


def test_long_cuts_are_not_remembered():
    found = unigram.Unigram(unigram.public_tokenizers.path("piece_bpe_32k.model"))
    for k in range(20):
        text = "日本語" * 2000 + str(k)
        assert found.decode(found.encode(text)) == text
    assert not found.known
    found.encode("short words")
    assert set(found.known) == {"short", "words"}
