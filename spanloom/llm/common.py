"""Helpers shared by the training-data operators.

Texts reach Python as Arrow batches.  `slices` cuts a batch into pieces of about a
megabyte so that numpy temporaries stay small whatever the batch size; a single text
is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources import shared

SLICE_BYTES = 1 << 20
#: bytes that Spark hands to Python at once, one row at least
BATCH_BYTES = 4 << 20
#: words are runs of anything but the six ASCII blanks
ASCII_BLANKS = b" \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- shared storage


def small_batches(spark: SparkSession) -> None:
    """Exchange at most BATCH_BYTES at once with Python, unless the session says otherwise.

    This sets spark.sql.execution.arrow.maxBytesPerBatch for the session, as plans read
    it when they run: texts are long, and the default of 10000 rows may hold gigabytes.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a new shared table and read it back, which cuts its lineage."""
    small_batches(df.sparkSession)
    return shared.materialize(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> "F.Column":
    """True for the fifth of documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# ---------------------------------------------------------------- Arrow texts


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about `limit` bytes of text, a row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(text_column(batch, column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column of a batch, or of its struct `row` (rows of a table are never null)."""
    if name in batch.schema.names:
        return batch.column(name)
    row = batch.column("row")
    return pc.cast(row.field(row.type.get_field_index(name)), pa.string())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and where each starts (one more at the end)."""
    column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


BLANK = np.zeros(256, bool)
BLANK[list(ASCII_BLANKS)] = True


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more at the end)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~BLANK[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = at[1:] - 1
    after[cuts[cuts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


# ---------------------------------------------------------------- 64-bit hashing

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """`n` fixed odd 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


_CODES = constants(256, 1)
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]


class _Powers:
    """Powers of the hash base and of its inverse, grown as longer texts come."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * SLICE_BYTES)
            ones = np.ones(size, np.uint64)
            ones[1:] = _BASE
            self.up = np.cumprod(ones, dtype=np.uint64)
            ones[1:] = _INVERSE
            self.down = np.cumprod(ones, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, by prefix sums of a polynomial hash."""
    up, down = _POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _CODES)[data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of k words that lie in one text.

    Also each window's first word and the index of each text's first window (one more
    at the end).
    """
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    begin = np.concatenate(([0], np.cumsum(counts)))
    if begin[-1] == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), begin
    heads = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    c = constants(k, 2 + k)
    total = words[heads] * c[0]
    for j in range(1, k):
        total += words[heads + j] * c[j]
    return mix64(total), heads, begin


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of `values` over each range between neighbouring entries of `at`."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
