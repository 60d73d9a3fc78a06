"""Operator 3: bounded-space online packing of documents into training sequences.

Every partition reads its documents once and keeps at most WINDOWS open windows of
LENGTH tokens.  A document's full stretches of LENGTH tokens become sequences of
their own; the rest goes into the open window that it fills best.  When none fits, a
new window is opened, after the fullest has been emitted if all WINDOWS are open.
Windows still open at the end of a partition are left over; they are merged, whole,
by the same rule over groups of MERGE partitions.  Memory per task is one batch of
documents, the open windows and a cache of word ids that is bounded in bytes.  A text of any length is
encoded in stretches of CHUNK bytes; it is held with its ids, never cut.

Windows are written with the token ids of their pieces.  `pack` returns every piece
with its ids, `sequences` the padded training sequences.

Token ids come from a tokenizer file of the `tokenizers` library.  Its pre-tokenizer
never joins across a blank and puts Latin-1 in lower case, so a stretch is lowered and
cut into words as a whole, the words are dictionary-encoded, distinct ones looked up in
the cache, and all ids gathered at once.  New words go through the tokenizer many at a
time.  A stretch that holds an added token in any case is left as it is.

Defined results: a null text counts as empty and has the end id alone.  Rows are
packed one by one, so repeated rows and null ids appear as often as they come in.  Of
windows with equal room the one opened first is filled, of equally full ones the one
opened first is emitted.  An
empty table gives an empty result.  Further columns are not read.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table, text_bytes

LENGTH = 2048
END_ID = 1
#: fills the rest of a sequence; its `used` tells where that begins
PAD_ID = 0
WINDOWS = 64
MERGE = 64
#: words of up to WORD characters whose ids a Python worker remembers, and bytes that it
#: holds for words and ids, before it starts anew
CACHE_WORDS = 500_000
CACHE_BYTES = 64 << 20
WORD = 64
#: bytes of text, and words, whose ids are looked up together
CHUNK = 1 << 20
GATHER = 1 << 18
#: new words that go through the tokenizer as one text
TOGETHER = 64


def _bytes(*ranges: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    for first, last in ranges:
        found[first : last + 1] = True
    return found


_SEPARATOR = _bytes(b"  ", b"\n\n")
_LETTER = _bytes(b"AZ", b"az")
_MARK = _bytes(b"!/", b":@", b"[`", b"{~")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: second bytes of letters from U+00C0 to U+00FF, and of those in upper case, whose first byte is LATIN
LATIN = 0xC3
_LATIN_LETTER = _bytes(b"\x80\x96", b"\x98\xb6", b"\xb8\xbf")
_LATIN_UPPER = _bytes(b"\x80\x96", b"\x98\x9e")
#: first bytes of what is not Latin-1
_WIDE = _bytes(b"\xc4\xff")
#: words that the pre-tokenizer leaves whole
_WHOLE = re.compile("[a-zß-öø-ÿ]+|[!-&(-/:-@\\[-`{-~]+")


class WordIds:
    """Token ids of texts by way of a cache of words.

    Words are numbered as they come; number 0 is the end of a text.  The ids of word k
    are flat[at[k] : at[k] + size[k]].
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        #: texts that the tokenizer takes out before it looks at words, in lower case
        self.added = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        if any(" " in x or "\n" in x for x in self.added):
            raise ValueError("an added token of the tokenizer goes across words")
        #: ids of tokens that end a word
        self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.last[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat = np.array([self.end_id], "<u4")
        self.at, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.bytes = 0

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, an end id behind each, and where each text starts (one more at the end)."""
        if len(self.known) > CACHE_WORDS or self.bytes + self.flat.nbytes > CACHE_BYTES:
            self._forget()
        data, at = text_bytes(column)
        gap = _SEPARATOR[data]
        starts, codes, lo = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        while lo < len(data):
            hi = lo + CHUNK
            while hi < len(data) and not gap[hi]:  # no chunk ends in a word
                hi += int(gap[hi : hi + 256].argmax()) or 256
            hi = min(hi, len(data))
            found, words = self._words(data[lo:hi], gap[lo:hi], at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo)
            starts.append(found + lo)
            codes.append(self._codes(words))
            lo = hi
        first = np.searchsorted(np.concatenate(starts), at)
        codes = np.insert(np.concatenate(codes), first[1:], 0)
        ends = np.concatenate(([0], np.cumsum(self.size[codes])))
        ids = np.empty(ends[-1], "<u4")
        for lo in range(0, len(codes), GATHER):
            part, to = codes[lo : lo + GATHER], ends[lo : lo + GATHER + 1]
            sizes = self.size[part]
            ids[to[0] : to[-1]] = self.flat[np.arange(to[0], to[-1]) + np.repeat(self.at[part] - to[:-1], sizes)]
        return ids, ends[first + np.arange(len(first))]

    def _words(self, data: np.ndarray, gap: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Where the words of a chunk start, and the words, without the blanks and newlines between.

        Words of Latin-1 are put in lower case, as the tokenizer does itself, and marks
        behind their letters made words of their own, as the pre-tokenizer cuts there.
        """
        start = np.empty(len(data), bool)
        start[0], start[1:] = True, gap[:-1]
        start[heads] = True
        start &= ~gap
        low = data.tobytes().lower()
        if not any(x.encode() in low for x in self.added):
            plain = np.ones(len(data), bool)
            if (wide := _WIDE[data]).any():
                word = np.cumsum(start)
                other = np.zeros(word[-1] + 1, bool)
                other[word[wide]] = True
                plain = ~other[word]
            low = np.where(plain, _LOWER[data], data)
            after = np.zeros(len(data), bool)
            after[1:] = data[:-1] == LATIN
            low[after & plain & _LATIN_UPPER[data]] += 32
            letter = _LETTER[data] | (after & _LATIN_LETTER[data])
            start[1:] |= letter[:-1] & _MARK[data[1:]] & plain[1:]
            data = low
        found, keep = np.flatnonzero(start), ~gap
        packed = data[keep]
        before = np.cumsum(keep)[found] - 1
        offsets = np.append(before, len(packed)).astype(np.int32)
        return found, pa.StringArray.from_buffers(len(found), pa.py_buffer(offsets), pa.py_buffer(packed))

    def _codes(self, words: pa.Array) -> np.ndarray:
        """Numbers of words; new ones are learnt."""
        found = words.dictionary_encode()
        names = found.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter((self.known.get(x, -1) for x in names), np.int64, len(names))
        if len(new := np.flatnonzero(numbers < 0)):
            numbers[new] = np.arange(len(self.at), len(self.at) + len(new))
            self._learn(names[new].tolist())
        return numbers[found.indices.to_numpy()]

    def _learn(self, words: list[str]) -> None:
        self.known.update((x, len(self.at) + k) for k, x in enumerate(words) if len(x) <= WORD)
        self.bytes += sum(len(x) for x in words if len(x) <= WORD)
        whole = [_WHOLE.fullmatch(x) is not None for x in words]
        ids: dict[str, np.ndarray] = {}
        simple = [x for x, one in zip(words, whole) if one]
        lists = [simple[k : k + TOGETHER] for k in range(0, len(simple), TOGETHER)]
        rest = [x for x, one in zip(words, whole) if not one]
        for names, done in zip(lists, self.tokenizer.encode_batch_fast([" ".join(x) for x in lists], add_special_tokens=False)):
            own = np.array(done.ids, "<u4")
            ends = np.flatnonzero(self.last[own]) + 1
            if len(ends) == len(names):
                ids.update(zip(names, np.split(own, ends[:-1])))
            else:
                rest += names
        if rest:
            done = self.tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)
            own = np.array(done.ids, "<u4")
            ends = np.searchsorted(np.array(done.word_ids, np.int64), np.arange(1, len(rest)))
            ids.update(zip(rest, np.split(own, ends)))
        pieces = [ids[x] for x in words]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.at = np.append(self.at, len(self.flat) + np.cumsum(sizes) - sizes)
        self.size = np.append(self.size, sizes)
        self.flat = np.concatenate([self.flat, *pieces])


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


class OpenWindows:
    """At most `most` open windows; `closed` gathers those that are full or emitted."""

    def __init__(self, most: int, length: int) -> None:
        self.most, self.length, self.opened = most, length, 0
        self.room: list[tuple[int, int]] = []  # (room, window), ascending
        self.items: dict[int, list] = {}
        self.closed: list[tuple[int, list]] = []

    def _close(self, window: int) -> None:
        self.closed.append((window, self.items.pop(window)))

    def place(self, item, size: int) -> None:
        """Put an item where it leaves the least room; one that fills a window by itself needs no open one."""
        if size == self.length:
            self.closed.append((self.opened, [(item, 0)]))
            self.opened += 1
            return
        k = bisect_left(self.room, (size, -1))
        if k < len(self.room):
            room, window = self.room.pop(k)
        else:
            if len(self.room) == self.most:
                self._close(self.room.pop(0)[1])
            room, window = self.length, self.opened
            self.opened += 1
            self.items[window] = []
        self.items[window].append((item, self.length - room))
        if room > size:
            insort(self.room, (room - size, window))
        else:
            self._close(window)


_PIECE = ["doc_id", "start", "length", "doc_tokens", "offset"]


def _pack(path: str, windows: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, state = encoder(path), OpenWindows(windows, length)
        part, kind = TaskContext.get().partitionId(), None

        def rows(found: list[tuple[int, list]], still_open: bool) -> pa.RecordBatch:
            """One row a window: the ids of its pieces end to end, and the pieces."""
            out = [(*item[:-1], offset) for _, items in found for item, offset in items]
            fields = [pa.array(x, kind if k == 0 else pa.int64()) for k, x in enumerate(zip(*out))]
            at = np.cumsum([0, *(len(items) for _, items in found)])
            ids = [b"".join([item[-1] for item, _ in items]) for _, items in found]
            arrays = [
                pa.array([part] * len(found), pa.int64()), pa.array([x for x, _ in found], pa.int64()), pa.array([still_open] * len(found), pa.bool_()),
                pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(fields, _PIECE)),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["part", "window", "open", "used", "ids", "pieces"])

        for batch in batches:
            kind = batch.schema.field("id").type
            for piece in slices(batch):
                found, at = encode.encode(piece.column("text"))
                ids, at = memoryview(found).cast("B"), at.tolist()
                for doc, base, end in zip(piece.column("id").to_pylist(), at, at[1:]):
                    for start in range(base, end, length):
                        size = min(length, end - start)
                        state.place((doc, start - base, size, end - base, bytes(ids[4 * start : 4 * (start + size)])), size)
                if state.closed:
                    yield rows(state.closed, False)
                    state.closed = []
        if state.items:
            yield rows(sorted(state.items.items()), True)

    return run


def _merge(windows: int, length: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        state = OpenWindows(windows, length)
        group = group.sort_values(["used", "part", "window"], ascending=[False, True, True])
        for part, window, used in zip(group.part, group.window, group.used):
            state.place((part, window), int(used))
        found = [*state.closed, *state.items.items()]
        rows = [(part, window, (key[0] << 33) + number, base) for number, items in found for (part, window), base in items]
        return pd.DataFrame(rows, columns=["part", "window", "merged", "base"], dtype="int64")

    return run


def _windows(docs: DataFrame, tokenizer: str | None, length: int, windows: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Windows closed in their partition, and those left over with their place `base` in a merged one."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    pieces = f"array<struct<doc_id:{kind}," + ",".join(f"{x}:bigint" for x in _PIECE[1:]) + ">>"
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    found = materialize(rows.mapInArrow(_pack(path, windows, length), f"part bigint, window bigint, open boolean, used bigint, ids binary, pieces {pieces}"), "windows")
    groups = found.where("open").select("part", "window", "used", F.expr(f"part div {MERGE}").alias("group"))
    merged = groups.groupBy("group").applyInPandas(_merge(windows, length), "part bigint, window bigint, merged bigint, base bigint")
    # odd numbers: windows closed in their partition; even ones: merged windows
    closed = found.where("NOT open").withColumn("sequence_id", (F.shiftleft("part", 33) + F.col("window")) * 2 + 1).withColumn("base", F.lit(0).cast("bigint"))
    rest = found.where("open").join(merged, ["part", "window"]).withColumn("sequence_id", F.col("merged") * 2)
    columns = ["sequence_id", "base", "used", "ids", "pieces"]
    return closed.select(columns), rest.select(columns)


def _moved(base, ids=None):
    """The pieces of a window at their offsets in the sequence; with `ids`, each has its own."""

    def one(x):
        own = [F.substring(ids, (x["offset"] * 4 + 1).cast("int"), (x["length"] * 4).cast("int")).alias("ids")] if ids is not None else []
        return F.struct(*[x[name].alias(name) for name in _PIECE[:-1]], (x["offset"] + base).alias("offset"), *own)

    return F.transform("pieces", one)


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, windows: int = WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    `ids` holds the piece's token ids as little-endian 32-bit bytes; `ids_crc32` is
    computed from it where it is asked for.
    """
    closed, rest = _windows(docs, tokenizer, length, windows, id_col, text_col)
    rows = closed.unionByName(rest).select("sequence_id", F.explode(_moved(F.col("base"), F.col("ids"))).alias("p")).select("sequence_id", "p.*")
    return rows.select(F.col("doc_id").alias(id_col), "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _padded(length: int, pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("ids").to_pylist()
            ids = np.full((len(found), length), pad, np.int32)
            for row, x in zip(ids, found):
                row[: len(x) // 4] = np.frombuffer(x, "<u4")
            at = pa.array(np.arange(0, ids.size + 1, length, dtype=np.int32))
            column = pa.ListArray.from_arrays(at, pa.array(ids.ravel()))
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", column)

    return run


def sequences(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, windows: int = WINDOWS, id_col: str = "doc_id", text_col: str = "text", pad: int = PAD_ID) -> DataFrame:
    """One row per training sequence: sequence_id, ids, used, pieces.

    `ids` are `length` token ids, of which the first `used` come from the pieces, in
    the order of their offsets, and the others are `pad`.
    """
    closed, rest = _windows(docs, tokenizer, length, windows, id_col, text_col)
    closed = closed.select("sequence_id", "ids", "used", "pieces")
    # at most `length` tokens meet in a group
    meet = rest.select("sequence_id", F.struct("base", "used", "ids", _moved(F.col("base")).alias("pieces")).alias("w")).groupBy("sequence_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    ids = F.aggregate("w", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    used = F.aggregate("w", F.lit(0).cast("bigint"), lambda done, x: done + x["used"])
    merged = meet.select("sequence_id", ids.alias("ids"), used.alias("used"), F.flatten(F.col("w")["pieces"]).alias("pieces"))
    rows = closed.unionByName(merged)
    kind = rows.schema["pieces"].dataType.simpleString()
    return rows.mapInArrow(_padded(length, pad), f"sequence_id bigint, ids array<int>, used bigint, pieces {kind}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
