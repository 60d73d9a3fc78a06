"""Operator 9: near-duplicates by min-max hashing.

A document's set holds the 64-bit hashes of its distinct five-word shingles (words
lower-cased in A-Z; with fewer words, the whole sequence is the one shingle).  Every
permutation is evaluated once per shingle and gives two signature slots, its minimum
and its maximum, so PERMUTATIONS evaluations give twice as many slots.  Bands of ROWS
slots propose candidates; a band takes minima or maxima of different permutations, so
its rows are independent.  At similarity 0.85 a pair misses all bands with a chance
of (1 - 0.85 ** 6) ** 32 < 3e-7, at 0.8 of 6e-5; lower thresholds would need other bands.

1. Documents with equal sets collapse to one node, named by their smallest id, so
   copies in any number cost one node.
2. Every bucket has a hub, its member with the most crowded buckets; members are
   compared with their hubs.  In a family of near copies the hub lies in the middle
   and links most of them at once.
3. Pairs with a hub whose signatures rule the threshold out by over six standard
   deviations go; the rest is confirmed on the full sets.  Links become components by
   minimum labels with pointer jumping.
4. A hub whose members now share one component is done.  For the others all members
   are compared across components, exactly, in blocks of bounded size: a block pair
   is one task that counts common shingles by matrix products and returns a forest of
   the links it found.  Two nodes that share a bucket share its hub, so no candidate
   pair of different components is left out, and no pair is ever a row.

Defined results: null and blank texts have the empty set, link with nothing and are
their own component.  Rows that repeat a doc_id stand for one document.  A row with a
null doc_id takes no part: component_id null, kept true.  An empty table gives an
empty result.  Further columns are not read.  Sets are compared by 64-bit hashes.
Ties (which of several links joins two groups) do not change a component.  A long text
is hashed whole and takes some thirty times its size while it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import constants, materialize, mix64, slices, span_hashes, table, text_bytes, window_hashes, word_bounds

SHINGLE = 5
#: least similarity of a link, unless the caller names another
PERCENT = 85
PERMUTATIONS = 96
ROWS = 6
BANDS = 2 * PERMUTATIONS // ROWS
#: slots may fall short of the threshold by this share before a pair is ruled out
MARGIN = 0.17
#: pairs of sets smaller than this are confirmed without looking at signatures
SMALL = 64
#: members and shingles of a block at most (one document may hold more)
BLOCK = 2048
BLOCK_SHINGLES = 500_000
#: shingles that more members hold are counted by matrix products, others one by one
DENSE = 32
STRIP = 512
#: ids that may be broadcast; more are joined by shuffling
BROADCAST_IDS = 200_000
#: copies from which the component of a set is broadcast to them; raised on large tables,
#: so that there are at most BROADCAST_IDS such sets
HOT = 1000

_XOR = constants(PERMUTATIONS, 11)
_MULTIPLY = constants(PERMUTATIONS, 12)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of shingles of k words of all texts end to end, and where each starts (one more at the end)."""
    data, at = text_bytes(column)
    starts, ends, first = word_bounds(data, at)
    words = span_hashes(data, starts, ends, lower=True)
    windows, _, begin = window_hashes(words, first, k)
    count, c = np.diff(first), constants(k, 21)
    parts = []
    for i, m in enumerate(count):
        if m >= k:
            parts.append(np.unique(windows[begin[i] : begin[i + 1]]))
        elif m:
            parts.append(mix64(np.sum(words[first[i] : first[i + 1]] * c[:m], dtype=np.uint64, keepdims=True) + np.uint64(m)))
        else:
            parts.append(np.empty(0, np.uint64))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sixteen bits of the minimum, then of the maximum, under each permutation; a row per set."""
    out = np.zeros((len(at) - 1, 2 * PERMUTATIONS), np.uint16)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        heads = at[full]
        for p in range(PERMUTATIONS):
            x = (values ^ _XOR[p]) * _MULTIPLY[p]
            out[full, p] = mix64(np.minimum.reduceat(x, heads)) >> np.uint64(48)
            out[full, PERMUTATIONS + p] = mix64(np.maximum.reduceat(x, heads)) >> np.uint64(48)
    return out


def set_keys(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set."""
    keys = []
    for seed in constants(2, 31):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix64(values ^ seed), out=total[1:])
        keys.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return keys[0], keys[1]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            values, at = shingle_sets(part.column("text"))
            hi, lo = set_keys(values, at)
            rows = [x.tobytes() for x in signatures(values, at)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(at)), pa.array(hi), pa.array(lo), pa.array(rows, pa.binary())], ["id", "n_shingles", "hi", "lo", "signature"]
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            values, at = shingle_sets(part.column("text"))
            rows = [x.tobytes() for x in signatures(values, at)]
            sets = [values[at[i] : at[i + 1]].tobytes() for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(at)), pa.array(rows, pa.binary()), pa.array(sets, pa.binary())], ["node", "n", "signature", "members"])


def _likely(percent: int):
    least = 2 * PERMUTATIONS * (percent / 100 - MARGIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint16).reshape(-1, 2 * PERMUTATIONS) for x in ("one", "two"))
            small = batch.column("small").to_numpy(zero_copy_only=False)
            yield batch.select(["a", "b"]).filter(pa.array(small | ((one == two).sum(axis=1) >= least)))

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("one"), batch.column("two")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, two))
                both = np.sort(np.concatenate((x, y)))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, set key (hi, lo) and signature of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_sketches, f"id {rows.schema['id'].dataType.simpleString()}, n_shingles bigint, hi bigint, lo bigint, signature binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over `edges` (a, b), for every node on an edge."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        parent = labels.select(F.col("node").alias("p"), F.col("label").alias("above"))
        step = materialize(step.join(parent, step.label == parent.p).select("node", "was", F.least("label", "above").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("was <> label").isEmpty():
            return labels


def _links(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    light = active.select("node", "n", "signature")
    both = pairs.join(light.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("signature").alias("one")), "a")
    both = both.join(light.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("two")), "b")
    near = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = near.select("a", "b", "one", "two", (F.least("na", "nb") < SMALL).alias("small"))
    kind = pairs.schema["a"].dataType.simpleString()
    near = near.mapInArrow(_likely(percent), f"a {kind}, b {kind}")
    full = active.select("node", "members")
    near = near.join(full.select(F.col("node").alias("b"), F.col("members").alias("two")), "b")
    near = near.join(full.select(F.col("node").alias("a"), F.col("members").alias("one")), "a")
    return near.select("a", "b", "one", "two").mapInArrow(_confirmed(percent), f"a {kind}, b {kind}")


def _common(sets: list[np.ndarray]):
    """Strips of the matrix of common shingles: first row, counts of STRIP rows with all rows."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, token, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    dense = held > DENSE
    column = np.cumsum(dense) - 1
    pick = dense[token]
    one, two = owner[pick], column[token[pick]]
    few = np.flatnonzero((held[token] > 1) & ~pick)
    few = few[np.argsort(token[few], kind="stable")]
    a, b = [], []
    for shift in range(1, DENSE):  # pairs of holders of one shingle, by their distance in the list
        same = token[few[shift:]] == token[few[:-shift]] if len(few) > shift else np.empty(0, bool)
        if not same.any():
            break
        x, y = owner[few[:-shift][same]], owner[few[shift:][same]]
        a += [x, y]
        b += [y, x]
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    width = int(dense.sum())
    for lo in range(0, n, STRIP):
        hi = min(n, lo + STRIP)
        found = np.zeros((hi - lo, n), np.float32)
        for left in range(0, width, 2048):
            part = np.zeros((n, min(2048, width - left)), np.float32)
            mine = (two >= left) & (two < left + 2048)
            part[one[mine], two[mine] - left] = 1
            found += part[lo:hi] @ part.T
        x, y = np.searchsorted(a, (lo, hi))
        np.add.at(found, (a[x:y] - lo, b[x:y]), 1)
        yield lo, found


def forest(nodes: list, labels: list, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple]:
    """Links (node, node) that join different labels, as many as it takes to join all that can be."""
    sizes = np.array([len(x) for x in sets])
    _, group = np.unique(np.array(labels), return_inverse=True)
    above = list(range(len(nodes)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    out = []
    for lo, common in _common(sets):
        linked = 100 * common >= percent * (sizes[lo : lo + len(common), None] + sizes - common)
        linked &= group[lo : lo + len(common), None] != group
        for i in np.flatnonzero(linked.any(axis=1)):
            partners = np.flatnonzero(linked[i])
            for j in partners[np.unique(group[partners], return_index=True)[1]]:
                x, y = top(int(group[lo + i])), top(int(group[j]))
                if x != y:
                    above[y] = x
                    out.append((nodes[lo + i], nodes[j]))
    return out


def _cell(percent: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        found = forest(rows.node.tolist(), rows.label.tolist(), [np.frombuffer(x, np.uint64) for x in rows.members], percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype=rows.node.dtype)

    return run


def _links_within(members: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """Links across labels among the rows (hub, node, label) of every hub."""
    rows = members.join(active.select("node", "n"), "node")
    sizes = rows.groupBy("hub").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    rows = rows.join(sizes.select("hub", blocks.alias("k")), "hub").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    rows = rows.select("hub", "node", "label", F.explode(cells).alias("cell"))
    rows = rows.join(active.select("node", "members"), "node").select("hub", "node", "label", "cell.i", "cell.j", "members")
    kind = members.schema["node"].dataType.simpleString()
    return rows.groupBy("hub", "i", "j").applyInPandas(_cell(percent), f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept; links are pairs with a similarity of `percent` or more."""
    every = materialize(sketches(docs, id_col, text_col), "sketches")
    classes = every.where("n_shingles > 0 AND id IS NOT NULL").groupBy("hi", "lo").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    nodes = every.join(classes.select("hi", "lo", F.col("node").alias("id")), ["hi", "lo", "id"]).withColumnRenamed("id", "node")
    width = 2 * ROWS
    bands = [F.xxhash64(F.substring("signature", j * width + 1, width), F.lit(j)) for j in range(BANDS)]
    rows = nodes.select("node", F.explode(F.array(*bands)).alias("bucket"))
    crowds = rows.groupBy("bucket").agg(F.count("*").alias("crowd"), F.min("node").alias("x"), F.max("node").alias("y")).where("x < y")
    shared = materialize(rows.join(crowds.select("bucket", "crowd"), "bucket"), "buckets")

    nodes = materialize(shared.groupBy("node").agg(F.sum("crowd").alias("weight")), "active")
    ids = nodes.select("node")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    texts = texts.join(ids, texts.id == ids.node, "left_semi")
    active = materialize(texts.mapInArrow(_full_sets, f"node {kind}, n bigint, signature binary, members binary"), "sets")

    hubs = shared.join(nodes, "node").groupBy("bucket").agg(F.min(F.struct(-F.col("weight"), "node")).alias("h")).select("bucket", F.col("h.node").alias("hub"))
    around = materialize(shared.select("bucket", "node").join(hubs, "bucket").where("node <> hub").select("hub", "node").distinct(), "hubs")
    pairs = around.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    labels = components(_links(pairs, active, percent))

    members = around.unionByName(around.select("hub", F.col("hub").alias("node")).distinct())
    members = members.join(labels, "node", "left").select("hub", "node", F.coalesce("label", "node").alias("label"))
    mixed = members.groupBy("hub").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("hub")
    links = materialize(_links_within(materialize(members.join(mixed, "hub"), "members"), active, percent), "links")
    if not links.isEmpty():
        labels = merged(labels, links)

    return spread(every, classes, labels).select(F.col("id").alias(id_col), "n_shingles", F.col("own").alias("component_id"), F.coalesce(F.col("id") == F.col("own"), F.lit(True)).alias("kept"))


def spread(every: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, n_shingles, own): every row of `every` with the component of its set; empty sets and null ids are their own."""
    named = materialize(classes.join(labels, "node", "left").select("hi", "lo", "copies", F.coalesce("label", "node").alias("component")), "named")
    # documents of very common sets stay where they are
    hot = max(HOT, every.count() // BROADCAST_IDS)
    crowded = named.where(F.col("copies") > hot).select("hi", "lo", F.col("component").alias("known"))
    rows = every.select("id", "n_shingles", "hi", "lo").join(F.broadcast(crowded), ["hi", "lo"], "left")
    lone = rows.where("known IS NULL").drop("known").join(named.where(F.col("copies") <= hot).drop("copies"), ["hi", "lo"], "left")
    out = lone.unionByName(rows.where("known IS NOT NULL").withColumnRenamed("known", "component"))
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    own = F.when(F.col("id").isNotNull(), own)
    return out.select("id", "n_shingles", own.alias("own"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` whose document is the smallest of its component."""
    gone = materialize(near_duplicates(docs, id_col, text_col, percent).where("NOT kept").select(F.col(id_col).alias("gone")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: components of the graph whose nodes are the labels so far."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    edges = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    top = components(edges.where("a <> b")).select(F.col("node").alias("label"), F.col("label").alias("top"))
    lone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    every = labels.unionByName(lone)
    return materialize(every.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
