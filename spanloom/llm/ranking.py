"""Operator 12: ranked lexical search by NRA over impact-sorted posting lists.

1. Items (the queries) are taken in blocks of bounded size.  One pass over the documents
   keeps each document's length and how often it holds terms of the block's items.
   Spark sums up the statistics: documents, terms, documents a term.
2. A second pass reads that table.  A task makes an index of PART documents at a time:
   a posting list a term, sorted by impact, highest first.  For every item NRA reads its
   lists side by side, in steps that double.  A document's lower bound sums the impacts
   read so far; its upper bound adds, for every list in which it has not been met, the
   impact next to be read there.  Reading goes on until no document outside the best K,
   met or not, has an upper bound as high as the K-th lower bound, and every document
   that reaches it, ties included, has equal bounds: then membership, ties and scores are
   final.  The best K of a task's earlier documents count from the start, so later parts
   are read less deep.
3. A task gives at most K rows an item; the best K of all are the result.

Nothing is shuffled but statistics and those rows, so neither frequent terms nor copies
make a hot key.  Scores are 64-bit integers; equal scores go by document id.

Defined results: null texts and texts without terms match nothing, items without terms
have no rows; a document must score above 0.  Rows that repeat a doc_id are documents of
their own, a null doc_id comes last among equal scores.  Rows that repeat an item_id are
one item with the least of their texts.  Empty tables give an empty result.  Further
columns are not read.  Terms are compared by 64-bit hashes.  A long text is hashed whole
and takes some thirty times its size while it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices, span_hashes, sums, table, text_bytes

K = 10
#: documents, and postings, of a task's index at most (one document may hold more)
PART = 8192
POSTINGS = 2_000_000
#: items, and bytes of their texts, that are searched together
BLOCK_ITEMS = 1000
BLOCK_BYTES = 1 << 20
#: postings that are read from every list in the first step
STEP = 64

#: bytes of terms: ASCII letters and digits, and whatever is not ASCII
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts end to end, and where each text's start (one more at the end)."""
    data, at = text_bytes(column)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    inside = TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[at] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
    return span_hashes(data, starts, ends, lower=True), np.searchsorted(starts, at)


def _held(asked: np.ndarray):
    """Per document: its number of terms, and which of the asked ones it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found, at = terms(part.column("text"))
                where = np.minimum(np.searchsorted(asked, found), max(len(asked) - 1, 0))
                hit = asked[where] == found if len(asked) else np.zeros(len(found), bool)
                doc = np.repeat(np.arange(part.num_rows), np.diff(at))[hit]
                key, tf = np.unique(doc << 32 | where[hit], return_counts=True)
                offsets = pa.array(np.searchsorted(key >> 32, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key & 0xFFFFFFFF, tf)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(at)), *lists], ["id", "n", "terms", "tf"])

    return run


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The length factor m of documents with n terms; whole numbers of any size."""
    if docs and 75 * int(n.max(initial=0)) * docs >= 1 << 63:
        return np.array([25 + 75 * int(x) * docs // total for x in n], np.int64)
    return 25 + 75 * n * docs // max(total, 1)


class Item:
    """An item: its terms' numbers and coefficients (weight by repeats), and the best rows so far."""

    def __init__(self, terms: np.ndarray, factors: np.ndarray) -> None:
        self.terms, self.factors = terms, factors
        self.best: list[tuple] = []  # (-score, id is null, id)

    def take(self, rows: list[tuple], k: int) -> None:
        self.best = sorted([*self.best, *rows])[:k]


class Index:
    """Posting lists of a part: documents by impact, highest first."""

    def __init__(self, ids: list, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int) -> None:
        order = np.lexsort((-impact, term))
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(size + 1))

    def search(self, item: Item, k: int) -> int:
        """Bring the item's best rows up to date; returns how many postings were read."""
        first, last = self.start[item.terms], self.start[item.terms + 1]
        some = (last > first) & (item.factors > 0)
        at, last, factor = first[some], last[some], item.factors[some]
        before = np.array([-row[0] for row in item.best], np.int64)
        lower = np.zeros(len(self.ids), np.int64)
        unmet = np.ones((len(at), len(self.ids)), np.int64)
        read, step = 0, STEP
        while True:
            upto = np.minimum(at + step, last)
            sizes = upto - at
            if not sizes.any():
                break
            of = np.repeat(np.arange(len(at)), sizes)
            where = np.arange(sizes.sum()) + np.repeat(at - (np.cumsum(sizes) - sizes), sizes)
            np.add.at(lower, self.doc[where], factor[of] * self.impact[where])
            unmet[of, self.doc[where]] = 0
            read, at, step = read + len(where), upto, 2 * step
            ahead = np.where(at < last, factor * self.impact[np.minimum(at, len(self.impact) - 1)], 0)
            known = np.concatenate((before, lower))
            least = int(np.partition(known, len(known) - k)[len(known) - k]) if len(known) >= k else 0
            if not least or ahead.sum() >= least:
                continue
            able = np.flatnonzero(lower + ahead.sum() >= least)
            if not (ahead @ unmet[:, able])[lower[able] + ahead @ unmet[:, able] >= least].any():
                break
        known = np.concatenate((before, lower))
        least = max(int(np.partition(known, len(known) - k)[len(known) - k]) if len(known) >= k else 1, 1)
        item.take([(-int(lower[d]), self.ids[d] is None, self.ids[d]) for d in np.flatnonzero(lower >= least)], k)
        return read


def _ranked(weights: np.ndarray, items: list[tuple], docs: int, total: int, k: int, part: int):
    """The best rows of a task, by items (number, term numbers, repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Item(t, weights[t] * repeats) for _, t, repeats in items]
        for batch in batches:
            at, n = np.asarray(batch.column("terms").offsets).astype(np.int64), batch.column("n").to_numpy()
            term, tf = (batch.column(x).flatten().to_numpy().astype(np.int64) for x in ("terms", "tf"))
            ids, at, lo = batch.column("id").to_pylist(), at - at[0], 0
            while lo < len(ids):
                hi = min(lo + part, max(lo + 1, int(np.searchsorted(at, at[lo] + POSTINGS, "right")) - 1))
                x, y = at[lo], at[hi]
                doc = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                impact = 1_000_000_000 * tf[x:y] // (1000 * tf[x:y] + 8 * lengths(n[lo:hi], docs, total)[doc])
                index = Index(ids[lo:hi], doc, term[x:y], impact, len(weights))
                for item in own:
                    index.search(item, k)
                lo = hi
        rows = [(number, doc, -score) for (number, _, _), item in zip(items, own) for score, _, doc in item.best]
        if rows:
            number, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(doc, batch.schema.field("id").type), pa.array(score, pa.int64())], ["item", "id", "score"])

    return run


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list]:
    """The items in blocks: (id, text) of up to about BLOCK_ITEMS items or BLOCK_BYTES."""
    rows = items.groupBy(F.col(item_col).alias("item")).agg(F.min(F.col(text_col).cast("string")).alias("text"))
    rows = materialize(rows, "items")
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for k in range(blocks):
        yield rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part: int = PART) -> DataFrame:
    """The `k` highest-scoring documents of every item: item id, rank, document id, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = rows.schema["id"].dataType.simpleString(), items.schema[item_col].dataType
    out = spark.createDataFrame([], f"item {item_kind.simpleString()}, id {kind}, score bigint")
    for block in _blocks(items, item_col, item_text_col):
        found, at = terms(pa.array([r.text for r in block], pa.string()))
        asked, number = np.unique(found, return_inverse=True)
        held = materialize(rows.mapInArrow(_held(asked), f"id {kind}, n bigint, terms array<int>, tf array<int>"), "held")
        n_docs, total = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(asked), np.int64)
        for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row an asked term
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        own = [(j, *np.unique(number[at[j] : at[j + 1]], return_counts=True)) for j in range(len(block))]
        best = held.where("size(terms) > 0").mapInArrow(_ranked(weights, own, n_docs, total, k, part), f"item int, id {kind}, score bigint")
        names = spark.createDataFrame([(j, r.item) for j, r in enumerate(block)], f"item int, name {item_kind.simpleString()}")
        out = out.unionByName(best.join(F.broadcast(names), "item").select(F.col("name").alias("item"), "id", "score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH held AS (SELECT doc_id, unnest({_TERMS.format("text")}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
stats AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM docs),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, stats GROUP BY term, docs),
asked AS (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN docs USING (doc_id) JOIN weights USING (term), stats GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
