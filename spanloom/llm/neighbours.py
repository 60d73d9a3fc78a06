"""Operator 2: approximate nearest neighbours by multiprobe p-stable hashing.

Each of L tables hashes a vector x by k functions floor((a.x + b) / w) with Gaussian
a.  A query does not stop at its own bucket: for every table it visits PROBES buckets
that differ from its own by -1 or +1 in some functions, in the order of their
estimated chance of holding a near neighbour (sum of squared distances to the cell
walls that are crossed).  Candidates of all tables meet in the same bounded top lists
and are ranked by exact distance.

Fitting measures instead of assuming: the exact neighbours of CALIBRATE queries among
all vectors are found in one pass.  w is a multiple of their distance, k grows with
the logarithm of the number of vectors, and L is the number of tables in whose visited
buckets a share of TARGET of those neighbours really lies; where MOST_TABLES tables do
not hold it, k is lowered until they do.  `Hashes.recall` keeps the measured share.
Every vector is indexed.

The first functions of a table name a cell of about CELL vectors, all of them a bucket
within it.  Vectors and queries meet by cell: a query sends one row to every cell it
visits, with the buckets it visits there, and is compared with the vectors of just
those buckets.  Both sides are gathered into lists of about BLOCK rows; a cell with
many lists of vectors is spread over several tasks.  Of equal vectors only the
nearest + 1 smallest ids are indexed, as no list can hold more of them.

A query that found fewer candidates than it wants, as it lies far from the others or
in a sparse region, tries wider cells (WIDER times w) and, if still short, is compared
with all indexed vectors, block by block.

Defined results: rows with a null id, and vectors that are null, empty, zero, of
another than the most common length, or hold null or non-finite components take no
part.  Rows that repeat a vec_id count as one candidate (the nearest) and one query
(the least of its vectors).  Ties go to the smaller id.  A list is shorter than
`nearest` only if the table has fewer other ids, and then holds them all; a table
without vectors gives an empty result.  Further columns are not read.  Vectors are the
only long values: a row is never larger than one vector and its visited buckets.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import constants, materialize, table

NEAREST = 10
PROBES = 1000
#: queries whose exact neighbours are found to measure recall
CALIBRATE = 64
#: vectors that cell sizes are estimated from
SAMPLE = 4000
#: cell width as a multiple of the 10th neighbour's distance (its 0.9 quantile)
WIDTH = 2.5
#: factor of the second, wider round
WIDER = 4.0
TARGET = 0.95
MOST_TABLES = 12
CELL = 8192
BLOCK = 256
#: lists of vectors that one task compares with all queries of their cell
LISTS = 64
#: rows that a task gathers before it cuts its lists back to the nearest
GATHER = 300_000
#: rows of a table of cell sizes that may be broadcast; larger ones are joined by shuffling
BROADCAST_CELLS = 200_000


@lru_cache(maxsize=8)
def moves(k: int, most: int) -> np.ndarray:
    """The most promising sets of wall crossings, a row each, best first.

    Column j stands for the j-th nearest of a vector's 2k cell walls.  Sets are ranked
    by the expected sum of squared distances; column j and column 2k - 1 - j are the two
    walls of one function, which no set crosses both.
    """
    j = np.arange(1, k + 1)
    near = j * (j + 1) / (4 * (k + 1) * (k + 2))
    far = (1 - j / (k + 1) + j * (j + 1) / (4 * (k + 1) * (k + 2)))[::-1]
    cost = np.concatenate((near, far))
    found: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(found) < most:
        total, picked = heapq.heappop(heap)
        if all(2 * k - 1 - x not in picked for x in picked):
            found.append(picked)
        last = picked[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*picked[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*picked, last + 1)))
    out = np.zeros((len(found), 2 * k), bool)
    for row, picked in zip(out, found):
        row[list(picked)] = True
    return out


class Hashes:
    """The functions of all tables, and 64-bit names of buckets and of cells of buckets."""

    def __init__(self, dim: int, k: int, tables: int, width: float, probes: int = PROBES, coarse: int = 0, seed: int = 17) -> None:
        rng = np.random.default_rng(seed)
        self.k, self.tables, self.width, self.probes, self.coarse = k, tables, width, probes, coarse
        # table by table, so that fewer tables are the first ones of more
        drawn = [(rng.standard_normal((dim, k)), rng.random(k)) for _ in range(tables)]
        self.a = np.concatenate([a for a, _ in drawn], axis=1) / width
        self.b = np.concatenate([b for _, b in drawn])
        self.mix = constants(k, 41)
        self.cell_mix = np.where(np.arange(k) < coarse, constants(k, 43), np.uint64(0))
        self.recall = 0.0

    def wider(self, factor: float) -> "Hashes":
        dim, k = self.a.shape[0], self.k
        return Hashes(dim, k, self.tables, self.width * factor, self.probes, self.coarse, seed=18)

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket and cell of every vector in every table, and its position in the functions' intervals."""
        at = vectors.astype(np.float64) @ self.a + self.b
        low = np.floor(at)
        shape = (len(vectors), self.tables, self.k)
        whole = low.astype(np.int64).view(np.uint64).reshape(shape)
        bucket, cell = ((whole * m).sum(axis=2, dtype=np.uint64) for m in (self.mix, self.cell_mix))
        return bucket, cell, (at - low).reshape(shape)

    def visits(self, bucket: np.ndarray, cell: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and cells to visit, most promising first; a row for every row of `inside`."""
        crossed = moves(self.k, 2 * self.probes)
        walls = np.concatenate((inside**2, (1 - inside) ** 2), axis=1)
        order = np.argsort(walls, axis=1)
        score = np.take_along_axis(walls, order, 1) @ crossed.T.astype(np.float64)
        best = np.argsort(score, axis=1, kind="stable")[:, : self.probes]
        out = []
        for start, mix in ((bucket, self.mix), (cell, self.cell_mix)):
            steps = np.concatenate((np.uint64(0) - mix, mix))[order]
            named = start[:, None] + steps @ crossed.T.astype(np.uint64)
            out.append(np.take_along_axis(named, best, 1))
        return out[0], out[1]


def _held(hashes: Hashes, asks: np.ndarray, found: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For neighbours (rows of `found`, of the query `owner`) and tables: is it in a visited bucket?"""
    bucket, cell, inside = hashes.cells(asks)
    own, _, _ = hashes.cells(found)
    out = np.zeros((len(found), hashes.tables), bool)
    for t in range(hashes.tables):
        seen, _ = hashes.visits(bucket[:, t], cell[:, t], inside[:, t])
        out[:, t] = (seen[owner] == own[:, t, None]).any(axis=1)
    return out


def fit(asks: np.ndarray, found: np.ndarray, owner: np.ndarray, reach: float, sample: np.ndarray, count: int) -> Hashes:
    """Choose k, L and the cells for `count` vectors.

    `found` holds the exact neighbours of the calibration queries `asks`, `owner` the row
    of the query that each belongs to; `sample` any vectors of the table.
    """
    dim, width = asks.shape[1], WIDTH * (reach or 1.0)
    k = int(np.clip(round(0.8 * math.log2(max(count, 2))), 4, 24))
    while True:
        hashes = Hashes(dim, k, MOST_TABLES, width)
        inside = _held(hashes, asks, found, owner)
        recall = np.maximum.accumulate(inside, axis=1).mean(axis=0) if len(found) else np.ones(MOST_TABLES)
        if recall[-1] >= TARGET or k == 1:
            break
        k -= 1
    enough = np.flatnonzero(recall >= TARGET)
    tables = max(2, int(enough[0]) + 1 if len(enough) else MOST_TABLES)
    for coarse in range(k + 1):
        hashes = Hashes(dim, k, tables, width, coarse=coarse)
        _, held = np.unique(hashes.cells(sample)[1][:, 0], return_counts=True)
        if count * float(((held / len(sample)) ** 2).sum()) <= CELL:
            break
    hashes.recall = float(recall[tables - 1])
    return hashes


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _raw(vectors: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in vectors], pa.binary())


def _index(hashes: Hashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                vectors = _matrix(part.column("vector"))
                bucket, cell, _ = hashes.cells(vectors)
                which = pa.array(np.repeat(np.arange(part.num_rows), hashes.tables))
                tables = np.tile(np.arange(hashes.tables, dtype=np.int32), part.num_rows)
                arrays = [pa.array(tables), pa.array(cell.ravel().view(np.int64)), part.column("id").take(which), pa.array(bucket.ravel().astype(np.uint32).view(np.int32)), _raw(vectors).take(which)]
                yield pa.RecordBatch.from_arrays(arrays, ["tab", "cell", "id", "bucket", "vector"])

    return run


def _sizes(hashes: Hashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cell, _ = hashes.cells(_matrix(batch.column("vector")))
            for t in range(hashes.tables if batch.num_rows else 0):
                names, held = np.unique(cell[:, t], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), t, np.int32)), pa.array(names.view(np.int64)), pa.array(held.astype(np.int64))], ["tab", "cell", "n"])

    return run


def _probes(hashes: Hashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                vectors = _matrix(part.column("vector"))
                bucket, cell, inside = hashes.cells(vectors)
                which, cells, lists, tables = [], [], [], []
                for t in range(hashes.tables):
                    seen, where = hashes.visits(bucket[:, t], cell[:, t], inside[:, t])
                    seen = seen.astype(np.uint32).view(np.int32)
                    for i in range(part.num_rows):
                        order = np.argsort(where[i], kind="stable")
                        names, first = np.unique(where[i][order], return_index=True)
                        cells.append(names)
                        lists += [x.tobytes() for x in np.split(seen[i][order], first[1:])]
                        which.append(np.full(len(names), i))
                        tables.append(np.full(len(names), t, np.int32))
                rows = pa.array(np.concatenate(which))
                arrays = [pa.array(np.concatenate(tables)), pa.array(np.concatenate(cells).view(np.int64)), part.column("id").take(rows), pa.array(lists, pa.binary()), _raw(vectors).take(rows)]
                yield pa.RecordBatch.from_arrays(arrays, ["tab", "cell", "id", "buckets", "vector"])

    return run


def _cut(q: np.ndarray, v: np.ndarray, d: np.ndarray, nearest: int):
    """The nearest distinct candidates of every query."""
    order = np.lexsort((d, v, q))
    q, v, d = q[order], v[order], d[order]
    first = np.ones(len(q), bool)
    first[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    q, v, d = q[first], v[first], d[first]
    order = np.lexsort((v, d, q))
    q, v, d = q[order], v[order], d[order]
    _, start, count = np.unique(q, return_index=True, return_counts=True)
    keep = np.arange(len(q)) - np.repeat(start, count) < nearest
    return q[keep], v[keep], d[keep]


def _visited(buckets: np.ndarray, lists: list[bytes]) -> np.ndarray:
    """For every list of visited buckets and every vector: is the vector's bucket on the list?"""
    names, which = np.unique(buckets, return_inverse=True)
    flat = np.frombuffer(b"".join(lists), np.int32)
    owner = np.repeat(np.arange(len(lists)), [len(x) // 4 for x in lists])
    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    hit = names[at] == flat
    out = np.zeros((len(lists), len(names)), bool)
    out[owner[hit], at[hit]] = True
    return out[:, which]


def _nearer(vi, vv, qi, qv, seen, nearest: int):
    """Rows (query, candidate) that may be among the nearest of one list of queries."""
    rough = (qv**2).sum(1)[:, None] + (vv**2).sum(1) - 2 * qv @ vv.T
    if seen is not None:
        rough[~seen] = np.inf
    # an id with several vectors counts once, at its nearest
    order = np.argsort(vi, kind="stable")
    own = vi[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    near = np.isfinite(rough)
    if len(first) > nearest + 1:
        # one more than wanted, as the query may be among its candidates
        least = rough if len(first) == len(own) else np.minimum.reduceat(rough[:, order], first, axis=1)
        edge = np.partition(least, nearest, axis=1)[:, nearest]
        near &= rough <= np.where(np.isfinite(edge), edge + 1e-9 * (1 + np.abs(edge)), np.inf)[:, None]
    a, b = np.nonzero(near)
    other = qi[a] != vi[b]
    a, b = a[other], b[other]
    return qi[a], vi[b], np.sqrt(((qv[a] - vv[b]) ** 2).sum(1))


def _compare(dtype: str, nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def rows(found) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                (vf, vi, vv), (qf, qi, qv) = (_side(batch.column(name)[r].values, dtype) for name in ("items", "asks"))
                seen = None
                if qf.type.get_field_index("buckets") >= 0:
                    seen = _visited(vf.field("bucket").to_numpy(zero_copy_only=False), qf.field("buckets").to_pylist())
                held.append(_nearer(vi, vv, qi, qv, seen, nearest))
                size += len(held[-1][0])
            if size > GATHER:
                held = [_cut(*(np.concatenate(x) for x in zip(*held)), nearest)]
                size = len(held[0][0])
                if size > GATHER // 2:
                    yield rows(held[0])
                    held, size = [], 0
        if held:
            yield rows(_cut(*(np.concatenate(x) for x in zip(*held)), nearest))

    return run


def _side(block: pa.StructArray, dtype: str):
    ids = block.field("id").to_numpy(zero_copy_only=False)
    vectors = np.frombuffer(b"".join(block.field("vector").to_pylist()), dtype)
    return block, ids, vectors.reshape(len(ids), -1).astype(np.float64)


def _salted(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add `salt`, so that (tab, cell, salt) holds about BLOCK rows, and the number of salts."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    return rows.join(sizes.select("tab", "cell", parts.alias("parts")), ["tab", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))


def _hinted(sizes: DataFrame) -> DataFrame:
    return F.broadcast(sizes) if sizes.count() <= BROADCAST_CELLS else sizes


def _hashed(index: DataFrame, asks: DataFrame, hashes: Hashes, dtype: str, nearest: int) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest among the vectors of the buckets that a query visits."""
    spark, kind = index.sparkSession, index.schema["id"].dataType.simpleString()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    items = index.mapInArrow(_index(hashes), f"tab int, cell bigint, id {kind}, bucket int, vector binary")
    sizes = index.mapInArrow(_sizes(hashes), "tab int, cell bigint, n bigint").groupBy("tab", "cell").agg(F.sum("n").alias("n"))
    sizes = _hinted(materialize(sizes, "cells"))
    stored = _salted(items, sizes).groupBy("tab", "cell", "salt").agg(F.collect_list(F.struct("id", "bucket", "vector")).alias("items"))
    stored = stored.select("tab", "cell", F.expr(f"salt div {LISTS}").cast("int").alias("part"), "items")
    visits = asks.repartition(parts, "id").mapInArrow(_probes(hashes), f"tab int, cell bigint, id {kind}, buckets binary, vector binary")
    # cells that hold no vector go here
    visits = materialize(visits.join(sizes.select("tab", "cell"), ["tab", "cell"], "left_semi"), "visits")
    asked = _salted(visits, _hinted(materialize(visits.groupBy("tab", "cell").agg(F.count("*").alias("n")), "asked")))
    asked = asked.groupBy("tab", "cell", "salt").agg(F.collect_list(F.struct("id", "buckets", "vector")).alias("asks"))
    every = F.sequence(F.lit(0), F.expr(f"CAST((ceil(n / {BLOCK}) - 1) div {LISTS} AS INT)"))
    asked = asked.join(sizes, ["tab", "cell"]).select("tab", "cell", F.explode(every).alias("part"), "asks")
    found = stored.join(asked, ["tab", "cell", "part"]).select("items", "asks")
    return _ranked(found.mapInArrow(_compare(dtype, nearest), f"query_id {kind}, vec_id {kind}, score double"), nearest)


def _whole(index: DataFrame, asks: DataFrame, count: int, dtype: str, nearest: int) -> DataFrame:
    """The same among all vectors: a stated set of `count` queries against all rows, in blocks."""
    spark, kind = index.sparkSession, index.schema["id"].dataType.simpleString()
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lists = -(-count // BLOCK)
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    block = f"block array<struct<id:{kind},vector:binary>>"
    asked = asks.mapInArrow(_encoded, f"id {kind}, vector binary").groupBy(F.pmod(F.xxhash64("id"), F.lit(lists)).cast("int").alias("list"))
    asked = asked.agg(F.collect_list(F.struct("id", "vector")).alias("asks")).withColumn("part", F.explode(number(spread)))
    stored = index.mapInArrow(_in_blocks, block).select(F.col("block").alias("items"), F.pmod(F.xxhash64(F.col("block")[0]["id"]), F.lit(spread)).cast("int").alias("part"))
    pairs = stored.withColumn("list", F.explode(number(lists))).join(asked, ["list", "part"]).select("items", "asks")
    return _ranked(pairs.mapInArrow(_compare(dtype, nearest), f"query_id {kind}, vec_id {kind}, score double"), nearest)


def _ranked(found: DataFrame, nearest: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every BLOCK rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            rows = pa.StructArray.from_arrays([part.column("id"), _raw(_matrix(part.column("vector")))], ["id", "vector"])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), rows)], ["block"])


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), _raw(_matrix(batch.column("vector")))], ["id", "vector"])


def _neighbours(ids: np.ndarray, asks: np.ndarray, nearest: int):
    """For a bounded set of queries: in every batch, the rows that may be among their nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                vectors, own = _matrix(part.column("vector")), part.column("id").to_numpy(zero_copy_only=False)
                wide = vectors.astype(np.float64)
                square = (asks**2).sum(1)[:, None] + (wide**2).sum(1) - 2 * asks @ wide.T
                square[ids[:, None] == own] = np.inf
                pick = np.argpartition(square, min(nearest, part.num_rows) - 1, axis=1)[:, :nearest]
                a, b = np.repeat(np.arange(len(ids)), pick.shape[1]), pick.ravel()
                fine = np.isfinite(square[a, b])
                a, b = a[fine], b[fine]
                exact = np.sqrt(((asks[a] - wide[b]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(a), part.column("id").take(pa.array(b)), pa.array(exact), _raw(vectors[b])], ["ask", "id", "score", "vector"])

    return run


def calibrated(index: DataFrame, asks: DataFrame, count: int, dtype: str, nearest: int = NEAREST) -> Hashes:
    """Hashes whose recall is measured on CALIBRATE of the queries against all vectors."""
    kind = index.schema["id"].dataType.simpleString()
    some = asks.orderBy(F.xxhash64("id"), "id").limit(CALIBRATE).collect()
    ids, vectors = np.array([r.id for r in some]), np.array([r.vector for r in some], dtype).astype(np.float64)
    near = index.mapInArrow(_neighbours(ids, vectors, nearest), f"ask bigint, id {kind}, score double, vector binary")
    turn = F.row_number().over(Window.partitionBy("ask").orderBy("score", "id"))
    best = near.withColumn("turn", turn).where(F.col("turn") <= nearest).select("ask", "score", "vector").collect()
    found = np.array([np.frombuffer(r.vector, dtype) for r in best], np.float64).reshape(len(best), vectors.shape[1])
    owner, score = np.array([r.ask for r in best], np.int64), np.array([r.score for r in best])
    far = [score[owner == i].max() for i in np.unique(owner)]
    sample = np.array([r.vector for r in index.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()], dtype)
    return fit(vectors, found, owner, float(np.quantile(far, 0.9)) if far else 1.0, sample, count)


def search(vectors: DataFrame, is_query, nearest: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row for which `is_query` holds."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)
    rows = rows.where(F.forall("vector", lambda x: F.coalesce(finite(x), F.lit(False))) & F.exists("vector", lambda x: x != 0))
    kind = rows.schema["id"].dataType.simpleString()
    nothing = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return nothing
    rows = rows.where(F.size("vector") == lengths["d"])
    dtype = "<f4" if rows.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"
    order = Window.partitionBy("vector").orderBy("id")
    # a row that stands several times takes one place
    index = rows.select("id", "vector").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= nearest + 1).drop("n")
    index = materialize(index, "vectors")
    asks = materialize(rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    if asks.isEmpty():
        return nothing
    hashes = calibrated(index, asks, lengths["count"], dtype, nearest)
    full = min(nearest, index.select("id").distinct().count() - 1)
    found = materialize(_hashed(index, asks, hashes, dtype, nearest), "found")
    for how in ("wider", "whole"):
        have = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("have"))
        short = materialize(asks.join(have, "id", "left").where(F.coalesce("have", F.lit(0)) < full).select("id", "vector"), "short")
        count = short.count()
        if not count:
            break
        more = _hashed(index, short, hashes.wider(WIDER), dtype, nearest) if how == "wider" else _whole(index, short, count, dtype, nearest)
        kept = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")
        found = materialize(kept.select(more.columns).unionByName(more), "found")
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
