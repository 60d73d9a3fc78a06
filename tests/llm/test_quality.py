import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from spanloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(hit)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t#|\x1c \U0001f600", max_size=40)), max_size=6))
def test_measures_equal_brute_force(texts):
    found = quality.measure(pa.array(texts, pa.string()))
    assert [[int(found[m][i]) for m in quality.MEASURES] for i in range(len(texts))] == [brute(x) for x in texts]


def test_edges_policy_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, 1), (1, good, 1), (None, good, 2), (2, None, 3), (3, "", 4), (4, "a b c " * 40, 5), (5, " ".join(f"word{i}***" for i in range(60)), 6), (6, good * 2000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    led = quality.apply_policy(quality.ledger(docs))
    kept = sorted(((r.doc_id or 0), r.kept) for r in led.collect())
    assert kept == [(0, True), (1, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, False)]
    out = quality.passing(docs)
    assert out.columns == docs.columns and sorted(r.n_words for r in out.collect()) == [1, 1, 2]
    table = {r.rule: (r.rejected, r.rejected_alone) for r in quality.ablation(led).collect()}
    assert table["few_words"] == (2, 2) and table["symbols"][0] == 1 and table["repeated_windows"][0] == 2
    assert quality.passing(docs.limit(0)).count() == 0 and quality.ledger(docs.limit(0)).count() == 0
