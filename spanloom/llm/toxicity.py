"""Operator 5: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all texts outside the held-out fifth, labelled
or not, are the unlabelled mixture.  The share of toxic texts (the class prior) is
estimated from all labels outside the held-out fifth.  A linear classifier on hashed
words is fitted in numpy to the non-negative risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

with the logistic loss: where the bracket turns negative, the classifier has begun to
fit single positives, and its step is taken back.  Features, all hashed, are
the distinct words of a text (runs of letters, lower-cased in A-Z) and for every stem
(a word's first bytes) whether one, two or three distinct words begin with it; a
text's evidence is the sum of their weights, so repeated words count once.

Learning reads at most POSITIVES positives and UNLABELLED texts, drawn by hashed id, and
one text of an id that stands several times (the least); scoring reads every whole text.
A long text is never cut; its distinct words take some forty bytes each.

Defined results: null and empty texts have no words and get the score that the bias
alone gives.  With no positives to learn from, every score is the prior (0.5 at most,
0 without labels).  Rows are scored one by one, so repeated rows and null ids pass
through; null ids count as not held out.  Several labels of one document: toxic if any
says so.  A score of exactly 0.5 counts as toxic.  An empty table gives an empty result.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, mix64, slices, span_hashes, table, text_bytes

BUCKET_BITS = 18
POSITIVES = 3000
UNLABELLED = 12000
EPOCHS = 200
BATCHES = 2
RATE = 0.05
DECAY = 1e-4
#: a word gets a weight if its share among positives is this many times its share among
#: unlabelled texts, and that many standard deviations above it
LIFT = 2.0
DEVIATIONS = 6.0
#: and if so many positives, and such a share of them, hold it: a handful of near copies
#: must not decide
LEAST_POSITIVES = 5
LEAST_SHARE = 0.02

#: bytes of a stem; a stem is one feature for each count of distinct words up to STEM_WORDS
STEM = 5
STEM_WORDS = 3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature buckets of every text end to end, and where each starts (one more at the end)."""
    data, at = text_bytes(column)
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(at), np.int64)
    inside = np.concatenate(([False], _LETTER[data], [False]))
    start, stop = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    heads, tails = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0] - 1
    start[heads] = inside[1:-1][heads]
    stop[tails] = inside[1:-1][tails]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    owner = np.searchsorted(at, starts, "right") - 1
    words = span_hashes(data, starts, ends, lower=True)
    _, once = np.unique(words + mix64(owner), return_index=True)
    starts, ends, owner, words = starts[once], ends[once], owner[once], words[once]
    stems = span_hashes(data, starts, np.minimum(ends, starts + STEM), lower=True)
    _, first, held = np.unique(stems + mix64(owner), return_index=True, return_counts=True)
    found, owners = [words], [owner]
    for k in range(1, STEM_WORDS + 1):
        some = first[held >= k]
        found.append(mix64(stems[some] + np.uint64(k)))
        owners.append(owner[some])
    bucket = (np.concatenate(found) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    keys = np.unique(np.concatenate(owners) << BUCKET_BITS | bucket)
    return keys & ((1 << BUCKET_BITS) - 1), np.searchsorted(keys, np.arange(len(at)) << BUCKET_BITS)


class Classifier:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(words) + 1)
        np.cumsum(self.weights[words], out=total[1:])
        return _sigmoid(self.bias + total[at[1:]] - total[at[:-1]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 5) -> Classifier:
    """Adam on the non-negative risk, over words that positives hold clearly more often."""
    size = 1 << BUCKET_BITS
    if not positive or not 0 < prior < 1:
        p = min(max(prior, 0.0), 0.5)
        return Classifier(np.zeros(size), float(np.log(p / (1 - p))) if p else -50.0)
    n, m = len(positive), max(1, len(unlabelled))
    in_pos, in_unl = (np.bincount(np.concatenate(x or [np.empty(0, np.int64)]), minlength=size) for x in (positive, unlabelled))
    share = (in_pos + in_unl) / (n + m)
    above = in_pos / n - in_unl / m
    often = (above > DEVIATIONS * np.sqrt(share * (1 - share) * (1 / n + 1 / m))) & (in_pos / n >= LIFT * in_unl / m)
    often &= in_pos >= max(LEAST_POSITIVES, LEAST_SHARE * n)
    column = np.cumsum(often) - 1
    width = int(often.sum())

    def rows(found):
        kept = [column[x[often[x]]] for x in found]
        return np.concatenate(kept) if kept else np.empty(0, np.int64), np.concatenate(([0], np.cumsum([len(x) for x in kept], dtype=np.int64)))

    def margin(data, pick):
        words, at = data
        sizes = at[pick + 1] - at[pick]
        owner = np.repeat(np.arange(len(pick)), sizes)
        mine = words[np.arange(sizes.sum()) + np.repeat(at[pick] - (np.cumsum(sizes) - sizes), sizes)]
        return np.bincount(owner, w[mine], len(pick)) + w[-1], mine, owner

    def slope(found, each):
        _, mine, owner = found
        out = np.bincount(mine, each[owner], width + 1)
        out[-1] = each.sum()
        return out

    pos, unl = rows(positive), rows(unlabelled)
    rng = np.random.default_rng(seed)
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(EPOCHS):
        shuffled = [np.array_split(rng.permutation(len(x)), BATCHES) for x in (positive, unlabelled)]
        for p, u in zip(*shuffled):
            if not len(p) or not len(u):
                continue
            a, b = margin(pos, p), margin(unl, u)
            sp, su = _sigmoid(a[0]), _sigmoid(b[0])
            # logistic loss: softplus(-m) for +, softplus(m) for -
            negative = np.logaddexp(0, b[0]).mean() - prior * np.logaddexp(0, a[0]).mean()
            bracket = slope(b, su / len(u)) - prior * slope(a, sp / len(p))
            g = prior * slope(a, (sp - 1) / len(p)) + bracket if negative >= 0 else -bracket
            g[:-1] += DECAY * w[:-1]
            step += 1
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(size)
    weights[often] = w[:-1]
    return Classifier(weights, float(w[-1]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words, at = word_features(part.column("text"))
            rows = [words[at[i] : at[i + 1]].astype(np.int32).tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("positive"), pa.array(rows, pa.binary())], ["positive", "words"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """Train on bounded samples of positives and of all texts."""
    seen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    seen = seen.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    prior = seen.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    toxic = seen.where("toxic > 0").select("label_id")
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # ids are drawn first, texts fetched for the drawn ones alone
    ids, key = rows.select("id").distinct(), F.xxhash64("id")
    drawn = ids.join(toxic, ids.id == toxic.label_id, "left_semi").orderBy(key, "id").limit(positives).withColumn("positive", F.lit(True))
    other = ids.orderBy(key, "id").limit(unlabelled).withColumn("positive", F.lit(False))
    picked = drawn.unionByName(other)
    one = rows.join(F.broadcast(picked), "id").groupBy("id", "positive").agg(F.min("text").alias("text"))
    sample = one.select("text", "positive").mapInArrow(_features, "positive boolean, words binary").collect()
    found = sorted((r.positive, bytes(r.words)) for r in sample)
    split = {kind: [np.frombuffer(x, np.int32).astype(np.int64) for p, x in found if p is kind] for kind in (True, False)}
    return train(split[True], split[False], float(prior))


def _scores(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = model.score(*word_features(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found)], ["id", "score"])

    return run


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_scores(model), f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
