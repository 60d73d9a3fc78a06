import random

import numpy as np
import pyarrow as pa

from spanloom.llm import langid


def sample(rng, lang, n):
    parts = {"aa": ["tho", "ing", "er", "an"], "bb": ["que", "ción", "ado", "ez"], "cc": ["sch", "ung", "ß", "ich"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    h = 3
    draw = lambda *s: rng.standard_normal(s)
    layer = langid.Layer(draw(256, h), draw(256, h), draw(256, h), draw(h, h), draw(h, h), draw(h, h), draw(h), draw(h, 2))
    x = np.array([1, 2, 2])
    state, goal = draw(3, h), draw(3, h)

    def loss():
        return float((layer.step(x, state)[0] * goal).sum())

    grad = langid.Layer(*(np.zeros_like(p) for p in vars(layer).values()))
    out = layer.back(layer.step(x, state)[1], goal, grad)
    for p, g in [(getattr(layer, n), getattr(grad, n)) for n in ("reset_in", "update_in", "new_in", "reset", "update", "new", "bias")] + [(state, out)]:
        for k in rng.choice(p.size, min(p.size, 12), replace=False):
            keep = p.flat[k]
            p.flat[k] = keep + 1e-6
            up = loss()
            p.flat[k] = keep - 1e-6
            down = loss()
            p.flat[k] = keep
            assert abs((up - down) / 2e-6 - g.flat[k]) < 1e-5


def test_windows_cover_whole_texts():
    data = np.arange(200, dtype=np.uint8)
    rows, used, first = langid.windows(data, np.array([0, 0, 97, 200]))
    assert first.tolist() == [0, 0, 2, 4] and used.tolist() == [96, 1, 96, 7]
    assert np.concatenate([r[:u] for r, u in zip(rows, used)]).tolist() == data.tolist()


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, sample(rng, lang, 40), lang, "x"))
    rows += [(900, None, "aa", None), (901, "", "aa", None), (902, "123 +-", "bb", None), (None, sample(rng, "bb", 30), None, None), (903, sample(rng, "cc", 60_000), None, None), (903, "tho", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    net = langid.fit(docs)
    got = langid.predict(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    lang = {r[0]: r[2] for r in rows[:240]}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert len(held) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.95 * len(held)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902)} == {("und", 0.0)}
    assert [r.lang_pred for r in got if r.doc_id is None] == ["bb"]
    out = langid.identified(docs, net)
    assert out.columns == docs.columns and not {900, 901, 902} & {r.doc_id for r in out.collect()}
    assert langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), net).count() == 0


def test_pooling_is_a_mean_over_positions():
    net = langid.train([b"abc" * 40, b"xyz" * 40], ["p", "q"])
    found = langid.pooled(net, pa.array(["abc" * 500, "", None, "xyz" * 3]))
    assert np.allclose(found.sum(axis=1), [1, 0, 0, 1], atol=1e-5) and found[0].argmax() == 0 and found[3].argmax() == 1


def test_sample_of_a_hot_language(spark):
    rows = [(i, f"text number {i}", "en" if i % 10 else "de") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.sampled(docs, per_language=300)
    got = {}
    for r in found.orderBy("lang", "turn").collect():
        got.setdefault(r.lang, []).append((r.k, r.piece))
    every = {}
    for r in langid.sampled(docs, per_language=10_000).collect():
        every.setdefault(r.lang, []).append((r.k, r.piece))
    assert len(every["en"]) > 2000
    assert got == {lang: sorted(x)[:300] for lang, x in every.items()}
    # the first exchange, the lowest in the plan, deals a language to many tasks
    plan = found._jdf.queryExecution().executedPlan().toString()
    first = [x for x in plan.splitlines() if "hashpartitioning" in x][-1]
    assert "lang" in first and "pmod" in first or "_w" in first


def test_pooled_probabilities_equal_a_plain_loop():
    import math

    import pyarrow as pa

    net = langid.train([b"the quick brown fox " * 3, "el niño y la casa ".encode() * 3] * 30, ["en", "es"] * 30)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def states(layer, data):
        h, out = [0.0] * len(layer.bias), []
        for byte in data:
            dot = lambda m, j: sum(h[i] * float(m[i, j]) for i in range(len(h)))
            new = []
            for j in range(len(h)):
                r = sigmoid(2 * (float(layer.reset_in[byte, j]) + dot(layer.reset, j)))
                z = sigmoid(2 * (float(layer.update_in[byte, j]) + dot(layer.update, j)))
                c = math.tanh(float(layer.new_in[byte, j]) + r * (dot(layer.new, j) + float(layer.bias[j])))
                new.append(z * h[j] + (1 - z) * c)
            h = new
            out.append(h)
        return out

    def brute(text):
        data, total = text.encode(), [0.0] * len(net.languages)
        for lo in range(0, len(data), langid.WINDOW):
            window = data[lo : lo + langid.WINDOW]
            padded = window + bytes(langid.WINDOW - len(window))
            ahead, behind = states(net.ahead, padded), states(net.behind, padded[::-1])[::-1]
            for t in range(len(window)):
                scores = [float(net.bias[k]) + sum(ahead[t][i] * float(net.ahead.out[i, k]) + behind[t][i] * float(net.behind.out[i, k]) for i in range(len(ahead[t]))) for k in range(len(total))]
                top = sum(math.exp(s - max(scores)) for s in scores)
                total = [x + math.exp(s - max(scores)) / top for x, s in zip(total, scores)]
        return [x / max(1, len(data)) for x in total]

    texts = ["the fox and el zorro", "ñ", "", "a much longer text that takes more than a single window of bytes " * 3]
    got = langid.pooled(net, pa.array(texts))
    for text, row in zip(texts, got):
        assert max(abs(a - b) for a, b in zip(row, brute(text))) < 1e-4


def test_the_draw_is_bounded_over_all_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_WINDOWS", 12)
    seen = {}
    monkeypatch.setattr(langid, "train", lambda texts, labels: seen.update(labels=labels))
    rows = [(i, f"text number {i} with letters", f"l{i % 5}") for i in range(400)]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {x: seen["labels"].count(x) for x in set(seen["labels"])}
    assert sum(counts.values()) == 12 and set(counts) == {f"l{i}" for i in range(5)} and max(counts.values()) == 3
