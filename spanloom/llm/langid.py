"""Operator 1: language identification by a bidirectional gated recurrent network over bytes.

Training: up to PER_LANGUAGE windows of WINDOW bytes per language and MOST_WINDOWS in
all, drawn by hashed id from anywhere in the texts outside the held-out fifth, are brought to the driver; two
gated recurrent layers (one a direction) and a softmax on both states at every
position are fitted in numpy by backpropagation through time.

Prediction: every whole text is cut into windows, every position of every window gets
label probabilities, and a document's probabilities are the mean over all its
positions.  Only the text is looked at.

Defined results: a null text and one without a letter are `und` with score 0.  When
nothing can be learnt from (no labelled text outside the held-out fifth), every text
is `und`.  Rows are labelled one by one, so repeated rows and null ids pass through;
a null id counts as not held out.  An empty table gives an empty result.  Further
columns are not read by `predict` and returned unchanged by `identified`.  Languages of
equal probability: the first in order of their names.  A long text is read whole, its
windows TOGETHER at a time; it takes some ten times its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, slices, table, text_bytes, text_column

UNKNOWN = "und"
HIDDEN = 8
#: bytes read by a recurrent layer in one go
WINDOW = 96
#: windows that are learnt from, per language at most
PER_LANGUAGE = 1200
#: and in all, if there are that many languages: a first one of each, then a second one
MOST_WINDOWS = 40_000
STEPS = 260
BATCH = 160
RATE = 0.02
#: windows that go through the network together
TOGETHER = 2048
#: pooled probability below which `identified` rejects a text
LEAST_SCORE = 0.4


@dataclass
class Layer:
    """One direction; weights of the two gates give half the pre-activation."""

    reset_in: np.ndarray  # 256 x H
    update_in: np.ndarray  # 256 x H
    new_in: np.ndarray  # 256 x H
    reset: np.ndarray  # H x H
    update: np.ndarray  # H x H
    new: np.ndarray  # H x H
    bias: np.ndarray  # H, on the recurrent part of the new state
    out: np.ndarray  # H x K

    def step(self, x: np.ndarray, h: np.ndarray):
        """Next state for bytes `x` (and what going backwards needs)."""
        r, z = self.reset_in.take(x, 0, mode="clip"), self.update_in.take(x, 0, mode="clip")
        r += h @ self.reset
        z += h @ self.update
        for gate in (r, z):
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
        m = h @ self.new
        m += self.bias
        c = self.new_in.take(x, 0, mode="clip")
        c += r * m
        np.tanh(c, out=c)
        d = h - c
        d *= z
        d += c
        return d, (x, h, r, z, m, c)

    def back(self, kept, dh: np.ndarray, grad: "Layer") -> np.ndarray:
        x, h, r, z, m, c = kept
        dc = dh * (1 - z) * (1 - c * c)
        dm = dc * r
        # d sigmoid / d half the pre-activation is twice s(1 - s)
        dr, dz = 2 * dc * m * r * (1 - r), 2 * dh * (h - c) * z * (1 - z)
        out = dh * z + dm @ self.new.T
        for slope, into, state in ((dr, grad.reset_in, self.reset), (dz, grad.update_in, self.update), (dc, grad.new_in, None)):
            np.add.at(into, x, slope)
            if state is not None:
                out += slope @ state.T
        grad.reset += h.T @ dr
        grad.update += h.T @ dz
        grad.new += h.T @ dm
        grad.bias += dm.sum(axis=0)
        return out


@dataclass
class Network:
    languages: list[str]
    ahead: Layer
    behind: Layer
    bias: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        """x: positions by windows; label scores of every position of every window."""
        steps, n = x.shape
        x = x.astype(np.intp)
        out = np.empty((steps, n, len(self.bias)), np.float32)
        out[:] = self.bias
        for layer, order in ((self.ahead, range(steps)), (self.behind, range(steps - 1, -1, -1))):
            h = np.zeros((n, len(layer.bias)), np.float32)
            for t in order:
                h, _ = layer.step(x[t], h)
                out[t] += h @ layer.out
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    """Probabilities by scores along the first axis."""
    x = x - x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts into rows of WINDOW bytes: rows, bytes used in each, first row of each text (one more at the end)."""
    sizes = np.diff(at)
    counts = -(-sizes // WINDOW)
    first = np.concatenate(([0], np.cumsum(counts)))
    k = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    heads = np.repeat(at[:-1], counts) + k * WINDOW
    used = np.minimum(WINDOW, np.repeat(at[1:], counts) - heads)
    spots = np.minimum(heads[:, None] + np.arange(WINDOW), max(len(data) - 1, 0))
    rows = np.where(np.arange(WINDOW) < used[:, None], data[spots], 0) if len(data) else np.empty((0, WINDOW), np.uint8)
    return rows.astype(np.uint8), used, first


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Network | None:
    """Fit a network by Adam on mean cross-entropy over all positions."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    k, h = len(languages), HIDDEN
    draw = lambda *shape: (rng.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)
    layers = [Layer(draw(256, h) * 4, draw(256, h) * 4, draw(256, h) * 8, draw(h, h) / 2, draw(h, h) / 2, draw(h, h), np.zeros(h, np.float32), draw(h, k)) for _ in range(2)]
    net = Network(languages, *layers, np.zeros(k, np.float32))
    where = {x: i for i, x in enumerate(languages)}
    goal = np.array([where[x] for x in labels])
    rows = np.zeros((len(texts), WINDOW), np.uint8)
    used = np.zeros(len(texts), np.int64)
    for i, x in enumerate(texts):
        used[i] = min(len(x), WINDOW)
        rows[i, : used[i]] = np.frombuffer(x[:WINDOW], np.uint8)
    # equal weight for every language
    weight = (1 / np.bincount(goal, minlength=k))[goal]
    weight /= weight.sum()
    params = [p for layer in layers for p in vars(layer).values()] + [net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        pick = rng.choice(len(texts), BATCH, p=weight)
        x, y, mask = rows[pick].T.astype(np.intp), goal[pick], np.arange(WINDOW)[:, None] < used[pick]
        grads = [Layer(*(np.zeros_like(p) for p in vars(layer).values())) for layer in layers]
        kept = []
        scores = np.zeros((WINDOW, BATCH, k), np.float32) + net.bias
        for layer, order in zip(layers, (range(WINDOW), range(WINDOW - 1, -1, -1))):
            state, own = np.zeros((BATCH, h), np.float32), [None] * WINDOW
            for t in order:
                state, held = layer.step(x[t], state)
                own[t] = (held, state)
                scores[t] += state @ layer.out
            kept.append(own)
        slope = np.moveaxis(_softmax(np.moveaxis(scores, -1, 0)), 0, -1).copy()
        slope[:, np.arange(BATCH), y] -= 1
        slope *= mask[:, :, None] / max(1, mask.sum())
        for layer, grad, own, order in zip(layers, grads, kept, (range(WINDOW - 1, -1, -1), range(WINDOW))):
            dh = np.zeros((BATCH, h), np.float32)
            for t in order:
                held, state = own[t]
                grad.out += state.T @ slope[t]
                dh = layer.back(held, dh + slope[t] @ layer.out.T, grad)
        every = [g for grad in grads for g in vars(grad).values()] + [slope.sum(axis=(0, 1))]
        rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
        for p, g, a, b in zip(params, every, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def pooled(net: Network, column: pa.Array) -> np.ndarray:
    """Mean label probabilities of every text; zeros for empty ones."""
    data, at = text_bytes(column)
    rows, used, first = windows(data, at)
    total = np.zeros((len(rows) + 1, len(net.languages)))
    for lo in range(0, len(rows), TOGETHER):
        part, size = rows[lo : lo + TOGETHER], used[lo : lo + TOGETHER]
        found = _softmax(np.moveaxis(net.logits(part.T), -1, 0).copy())
        found *= np.arange(WINDOW)[:, None] < size
        total[lo + 1 : lo + 1 + len(part)] = found.sum(axis=1).T
    np.cumsum(total, axis=0, out=total)
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(1, np.diff(at))[:, None]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _predictions(net: Network | None, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                column = text_column(part, text)
                lettered = np.array([has_letter(x) for x in column.to_pylist()], bool)
                names, score = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if net:
                    found = pooled(net, column)
                    best = found.argmax(axis=1)
                    names[lettered] = np.array(net.languages, object)[best[lettered]]
                    score[lettered] = np.minimum(1, found[np.arange(len(best)), best][lettered])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(names, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return run


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, turn, piece: one window a document, from anywhere in its text, of so many documents a language at most."""
    key = F.xxhash64(F.col(id_col))
    text, size = F.col(text_col).cast("string"), F.char_length(F.col(text_col).cast("string"))
    start = F.pmod(key, F.greatest(F.lit(1), size - WINDOW // 2)) + 1
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), key.alias("k"), F.substring(text, start.cast("int"), F.lit(WINDOW)).alias("piece"))
    # in steps, so that no task takes all documents of a language
    for parts in (64, 8, 1):
        turn = F.row_number().over(Window.partitionBy("lang", F.pmod("k", F.lit(parts))).orderBy("k", "piece"))
        rows = rows.withColumn("turn", turn).where(F.col("turn") <= per_language)
    return rows


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Network | None:
    """Train on a bounded sample."""
    sample = sampled(docs, id_col, text_col, lang_col, per_language).orderBy("turn", "lang", "piece").limit(MOST_WINDOWS).collect()
    sample.sort(key=lambda r: (r.lang, r.turn))
    return train([r.piece.encode() for r in sample], [r.lang for r in sample])


def labelled(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """Every row of `docs` whole, as the struct `row`, with lang_pred and score."""
    whole = docs.select(F.struct(*[docs[f"`{x}`"] for x in docs.columns]).alias("row"))
    return whole.mapInArrow(_predictions(net, text_col), f"row {whole.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred and score of every row."""
    found = labelled(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), net)
    return found.select(F.col("row.id").alias(id_col), held_out(F.col("row.id")).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, net: Network | None, least: float = LEAST_SCORE) -> DataFrame:
    """Rows whose language is known with a pooled probability of `least` or more."""
    return labelled(docs, net).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
