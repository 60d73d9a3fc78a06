"""Operator 10: sharding along a Hilbert curve over document metadata.

Source, language and text size are quantised into cells of about equal row counts,
order kept (cut points by ranks of the whole strings among all rows, and by approximate
percentiles of the sizes), each document gets the
index of its cell on a Hilbert curve, rows are sorted by that index and the order is
cut into runs.  A run covers few cells that lie close together, so its minima and
maxima of all three dimensions are tight and readers can skip files by any of them.

Laws: `rows` cuts runs whose counts differ by one at most, `bytes` cuts at equal
shares of all bytes.  Rows with equal texts and metadata stay side by side.  The sort
key ends with the document id, so any hot source, cell or group of copies spreads
over as many sort partitions as its rows need.

Defined results: a null text has 16 bytes and CRC 0; null metadata counts as empty and sorts first and
null ids sort first.  Repeated rows are sharded like any others.  An empty table gives
an empty result.  Columns beyond those named are not read by
`hilbert_shards`, and written unchanged by `write_shards`.  Rows that agree in the whole
sort key (curve, CRC, size, id) are interchangeable.  Texts are hashed by Spark and never
reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SHARDS = 40
BITS = 6
#: bytes that a document takes besides its text
OVERHEAD = 16


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of points (rows) of 2**bits cells a dimension.

    The walk goes from the highest bit down and keeps the reflections and swaps that
    the curve has made so far applied to the lower bits.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            on = (x[d] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, 0) ^ swap
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = index << 1 | (x[d] >> level) & 1
    return index


def _curve(cuts: list[np.ndarray]):
    def cells(column: pa.Array, cut: np.ndarray) -> np.ndarray:
        if not pa.types.is_string(column.type):
            return np.searchsorted(cut, column.to_numpy(zero_copy_only=False), "right")
        found = column.dictionary_encode()
        names = found.dictionary.to_numpy(zero_copy_only=False)
        return np.searchsorted(cut, names, "right")[found.indices.to_numpy()] if len(names) else np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cells(batch.column(f"d{k}"), cut) for k, cut in enumerate(cuts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_index(np.stack(found, axis=1)))], [*batch.schema.names, "curve"])

    return run


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Sorted rows with `part`, their sort partition, and `at`, which grows in the order."""
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), name)


def _before(rows: DataFrame, **totals: "F.Column") -> DataFrame:
    """For every sort partition the totals of those before it, and of all: a row a partition."""
    parts = rows.groupBy("part").agg(*(x.alias(name) for name, x in totals.items()))
    before, every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    return materialize(parts.select("part", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in totals), *(F.sum(x).over(every).alias(f"{x}_all") for x in totals)), "parts")


def string_cuts(rows: DataFrame, column: str) -> np.ndarray:
    """First values of up to 2**BITS - 1 runs of whole strings, in order, that hold about equally many rows."""
    values = _numbered(rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")), ["v"], "values")
    upto = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("n_before") + F.coalesce(F.sum("n").over(upto), F.lit(0))
    ranked = values.join(F.broadcast(_before(values, n=F.sum("n"))), "part").withColumn("cell", F.floor(rank * (1 << BITS) / F.col("n_all")))
    found = ranked.groupBy("cell").agg(F.min("v").alias("v")).collect()
    return np.array(sorted(r.v for r in found)[1:], object)


def placed(docs: DataFrame, shards: int = SHARDS, law: str = "rows", id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = ("lang", "source"), whole: bool = False) -> DataFrame:
    """Every row with its shard and slot, the dimensions d0, d1, ..., and, if `whole`, itself as the struct `row`."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law!r}")
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    size = F.octet_length(raw).cast("bigint") + OVERHEAD
    dims = [*(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in dimensions), size]
    row = [F.struct(*[docs[f"`{x}`"] for x in docs.columns]).alias("row")] if whole else []
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(raw).alias("text_crc32"), *(x.alias(f"d{k}") for k, x in enumerate(dims)), *row)
    if not whole:
        rows = materialize(rows, "sizes")
    shares = [k / (1 << BITS) for k in range(1, 1 << BITS)]
    sizes = rows.agg(F.percentile_approx("size", shares, 10_000)).first()[0]
    cuts = [*(string_cuts(rows, f"d{k}") for k in range(len(dimensions))), np.unique(np.array(sizes or [], np.int64))]
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)
    out = _numbered(rows.mapInArrow(_curve(cuts), f"{schema}, curve bigint"), ["curve", "text_crc32", "size", "doc_id"], "sorted")
    out = out.join(F.broadcast(_before(out, n=F.count("*"), b=F.sum("size"))), "part")
    out = out.withColumn("rank", F.col("n_before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    if law == "rows":
        out = out.withColumn("shard", F.expr(f"least({shards - 1}, (rank * {shards}) div n_all)"))
        out = out.withColumn("slot", F.expr(f"rank - (shard * n_all + {shards - 1}) div {shards}"))
    else:
        upto = F.sum("size").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn("bytes_before", F.col("b_before") + F.coalesce(upto, F.lit(0)))
        out = out.withColumn("shard", F.expr(f"least({shards - 1}, (bytes_before * {shards}) div b_all)"))
        out = materialize(out, "cut")
        firsts = out.groupBy("shard").agg(F.min("rank").alias("first"))
        out = out.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("rank") - F.col("first"))
    return out.withColumn("shard", F.col("shard").cast("int")).withColumn("slot", F.col("slot").cast("bigint"))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, law: str = "rows", id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot and the curve index."""
    out = placed(docs, shards, law, id_col, text_col, dimensions)
    grown = F.lit(None).cast("int").alias("grown_shard")
    return out.select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", grown, "curve")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, law: str = "rows", id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Write the rows of `docs` under `path`, a folder _shard=N each, in the order of the curve.

    Returns one row per shard with its rows, bytes, and the least and greatest value of
    every dimension and of size, by which a reader skips shards.
    """
    out = placed(docs, shards, law, id_col, text_col, dimensions, whole=True)
    out.select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
    names = [*dimensions, "size"]
    ranges = [f(f"d{k}").alias(f"{how}_{x}") for k, x in enumerate(names) for how, f in (("min", F.min), ("max", F.max))]
    return out.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))
