import random

import numpy as np
import pyarrow as pa

from spanloom.llm import toxicity


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "se", "ta") for b in ("na", "pe", "qui", "ro", "ste", "vo", "wi")]
    bad = ["zapf", "grunx", "blorb"]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(20, 120))
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        docs.append((i, " ".join(text), None))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    rows, marks = corpus()
    rows += [(5000, None, None), (5001, "", None), (None, "zapf grunx blorb", None), (5002, "kana " * 100_000, None), (5002, "kana", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame(marks + [(None, 1), (7777, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(marks)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    assert len({r.score for r in got if r.doc_id in (5000, 5001)}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_risk_is_corrected_by_the_prior():
    """Unlabelled positives must not be learnt as negatives."""
    rng = np.random.default_rng(0)
    pos = [np.unique(np.concatenate(([7], rng.integers(100, 400, 30)))) for _ in range(200)]
    unl = [np.unique(np.concatenate(([7] if i % 5 == 0 else [], rng.integers(100, 400, 30))).astype(np.int64)) for i in range(1000)]
    model = toxicity.train(pos, unl, 0.2)
    score = model.score(np.array([7, 150, 150]), np.array([0, 2, 3]))
    assert score[0] > 0.5 > score[1]


def test_features_of_words_and_stems():
    words, at = toxicity.word_features(pa.array(["Idiot, idiot!", "idiot", None, "", "a1b"]))
    one, two = (set(words[at[i] : at[i + 1]].tolist()) for i in (0, 1))
    assert one == two and at[3] == at[2] == at[4 - 1] and at[5] - at[4] == 4


def test_scores_and_risk_equal_plain_loops():
    import math
    import re

    import numpy as np
    import pyarrow as pa

    from spanloom.llm.common import mix64, span_hashes

    def named(word, at=0, to=None):
        data = np.frombuffer(word.encode(), np.uint8)
        return span_hashes(data, np.array([at]), np.array([len(data) if to is None else min(to, len(data))]), lower=True)

    def bucket(x):
        return int(x[0] >> np.uint64(64 - toxicity.BUCKET_BITS))

    def brute(text):
        words, stems = {}, {}
        for word in re.findall("[A-Za-z\\x80-\U0010ffff]+", text):
            words[int(named(word)[0])] = word
        for word in words.values():
            stem = named(word, 0, toxicity.STEM)
            stems.setdefault(int(stem[0]), [stem, 0])[1] += 1
        out = {bucket(np.array([w], np.uint64)) for w in words}
        for stem, held in stems.values():
            out |= {bucket(mix64(stem + np.uint64(k))) for k in range(1, toxicity.STEM_WORDS + 1) if held >= k}
        return out

    clean = [f"plain words about number {i} and more of them" for i in range(60)]
    toxic = [f"awful horrid words about {i} vile things vileness" for i in range(30)]
    texts = [*clean, *toxic, "", "Vile VILE vile, été", None, "1 2 3"]
    words, at = toxicity.word_features(pa.array(texts, pa.string()))
    found = [words[a:b] for a, b in zip(at, at[1:])]
    assert [set(x.tolist()) for x in found] == [brute(x or "") for x in texts]
    model = toxicity.train(found[60:90], found[:90], 1 / 3)
    scores = model.score(words, at)
    for x, s in zip(found, scores):
        margin = model.bias + sum(float(model.weights[i]) for i in x)
        assert abs(s - 1 / (1 + math.exp(-margin))) < 1e-9

    def risk(model):
        """The non-negative risk with the logistic loss, term by term."""
        margin = lambda x: model.bias + sum(float(model.weights[i]) for i in x)
        loss = lambda m: math.log1p(math.exp(-m)) if m > -30 else -m
        pos = [margin(x) for x in found[60:90]]
        unl = [margin(x) for x in found[:90]]
        mean = lambda x: sum(x) / len(x)
        return mean([loss(m) for m in pos]) / 3 + max(0.0, mean([loss(-m) for m in unl]) - mean([loss(-m) for m in pos]) / 3)

    flat = toxicity.Classifier(np.zeros_like(model.weights), math.log(0.5))
    assert risk(model) < 0.2 * risk(flat)
    assert min(scores[60:90]) > 0.5 > max(scores[:60])


def test_repeated_ids_reach_the_driver_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda positive, unlabelled, prior: seen.update(n=(len(positive), len(unlabelled))))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b"), (4, "d")], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert seen["n"][0] <= 1 and seen["n"][1] <= 3
