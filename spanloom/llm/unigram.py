"""Operator 6: SentencePiece encoding and decoding with a unigram model.

Pieces come from a SentencePiece model file.  Their log scores follow Zipf's law over
the file's order (the file itself ranks pieces but has no probabilities), unless the
file's own scores are asked for.  The pieces live in a double-array trie over UTF-8
bytes; the best segmentation is found by Viterbi search, from left to right over the
pieces that start at each character.

Blanks become the marker U+2581 and one marker is put in front, as in SentencePiece.
No piece goes on from another character into a marker, so a text is cut before every
marker that follows another character and each cut is searched by itself, and short ones are remembered.
A character without pieces, and a U+2581 of the text itself, falls back to byte
pieces; so decoding gives every text back exactly, any character of Unicode included.
Ties go to the longer last piece.

Defined results: null and empty texts have no pieces.  Rows are encoded one by one, so
repeated rows and null ids pass through.  An empty table gives an empty result.
Further columns are not read.
A text is never cut short: a long one is searched cut by cut, and a cut without blanks
takes three lists as long as itself.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

MARK = "▁"
#: a byte piece scores this much less than the rarest piece
BYTE_PENALTY = 10.0
#: cuts of up to CUT characters whose ids a Python worker remembers, in two generations
CACHE_CUTS = 1_000_000
CUT = 64


class DoubleArray:
    """A trie in two arrays: child = base[node] + byte + 1, valid if check[child] == node.

    Leaves have base -1, which leads to the empty first cells.
    """

    def __init__(self, keys: dict[bytes, int]) -> None:
        self.base, self.check, self.value = [0], [-1], [-1]
        children: dict[bytes, list[int]] = {b"": []}
        for key in sorted(keys):
            for k in range(len(key)):
                if key[: k + 1] not in children:
                    children[key[: k + 1]] = []
                    children[key[:k]].append(key[k])
        # first free cell; where nodes of several children are tried from.  The first 257
        # cells stay empty, so that no base is negative
        free = roomy = 257
        todo = [(b"", 0)]
        while todo:
            prefix, node = todo.pop()
            self.value[node] = keys.get(prefix, -1)
            if not (codes := children[prefix]):
                continue
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            base = (free if len(codes) == 1 else max(free, roomy)) - codes[0] - 1
            tries = 0
            while any(base + c + 1 < len(self.check) and self.check[base + c + 1] >= 0 for c in codes):
                base, tries = base + 1, tries + 1
            if tries > 64:  # this stretch is crowded
                roomy = base + codes[0] + 1
            grow = base + codes[-1] + 2 - len(self.check)
            if grow > 0:
                for cells in (self.base, self.check, self.value):
                    cells.extend([-1] * grow)
            self.base[node] = base
            for c in codes:
                self.check[base + c + 1] = node
                todo.append((prefix + bytes([c]), base + c + 1))
        # so that no lookup runs past the end
        for cells in (self.base, self.check, self.value):
            cells.extend([-1] * 257)


def pieces(path: str, scores: str = "zipf") -> tuple[list[str], list[float], dict[int, int]]:
    """Pieces by id, their log scores (None for special ones) and the ids of byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    of_byte = {int(names[i][3:5], 16): i for i in range(len(names)) if model.is_byte(i)}
    plain = [i for i in range(len(names)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    found: list = [None] * len(names)
    total = math.log(sum(1 / (k + 1) for k in range(len(plain))))
    for rank, i in enumerate(plain):
        found[i] = model.get_score(i) if scores == "file" else -math.log(rank + 1) - total
    return names, found, of_byte


class Unigram:
    def __init__(self, path: str, scores: str = "zipf") -> None:
        names, self.scores, self.of_byte = pieces(path, scores)
        self.trie = DoubleArray({names[i].encode(): i for i, s in enumerate(self.scores) if s is not None})
        self.byte_score = min(s for s in self.scores if s is not None) - BYTE_PENALTY
        self.bytes = [x.replace(MARK, " ").encode() for x in names]
        for byte, i in self.of_byte.items():
            self.bytes[i] = bytes([byte])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def search(self, cut: str) -> list[int]:
        """Ids of the best segmentation of one cut."""
        data = cut.encode()
        n, base, check, value, scores = len(data), self.trie.base, self.trie.check, self.trie.value, self.scores
        best, came, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            now, node, k = best[at], 0, at
            while k < n:
                child = base[node] + data[k] + 1
                if check[child] != node:
                    break
                node, k = child, k + 1
                i = value[node]
                if i >= 0 and now + scores[i] > best[k]:
                    best[k], came[k], piece[k] = now + scores[i], at, i
            lead = data[at]
            end = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            if now + (end - at) * self.byte_score > best[end]:
                best[end], came[end], piece[end] = now + (end - at) * self.byte_score, at, -1
            at = end
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out.extend(self.of_byte[x] for x in reversed(data[came[n] : n]))
            n = came[n]
        return out[::-1]

    def _ids(self, cut: str) -> bytes:
        """Remembered ids of what stands between two blanks, a marker before it."""
        if len(cut) > CUT:
            return array("I", self.search(MARK + cut)).tobytes()
        found = self.known.get(cut)
        if found is None:
            found = self.older.get(cut)
            if found is None:
                found = array("I", self.search(MARK + cut)).tobytes()
            self.known[cut] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as native 32-bit bytes."""
        if not text:
            return b""
        if len(self.known) > CACHE_CUTS // 2:
            self.known, self.older = {}, self.known
        if MARK in text:
            return self._with_marks(text)
        if "  " in text or text[0] == " " or text[-1] == " ":
            return b"".join([self._run(x) for x in _cuts(MARK + text.replace(" ", MARK))])
        return b"".join(map(self._ids, text.split(" ")))

    def _run(self, cut: str) -> bytes:
        return self._ids(cut[1:]) if cut[0] == MARK else array("I", self.search(cut)).tobytes()

    def _with_marks(self, text: str) -> bytes:
        """A text that holds the marker itself: those characters become byte pieces."""
        byte = array("I", [self.of_byte[x] for x in MARK.encode()]).tobytes()
        first, *others = (x.replace(" ", MARK) for x in text.split(MARK))
        parts = [self._searched(MARK + first), *map(self._searched, others)]
        return byte.join(parts)

    def _searched(self, text: str) -> bytes:
        return b"".join([array("I", self.search(x)).tobytes() for x in _cuts(text)])

    def decode(self, ids: bytes) -> str:
        found = b"".join(map(self.bytes.__getitem__, array("I", ids)))
        return found[1:].decode(errors="replace")


def _cuts(text: str) -> list[str]:
    """Cut before every marker that follows another character."""
    out, at = [], 0
    for k in range(1, len(text)):
        if text[k] == MARK and text[k - 1] != MARK:
            out.append(text[at:k])
            at = k
    return [*out, text[at:]] if text else []


_MODELS: dict[tuple[str, str], Unigram] = {}


def model(path: str, scores: str = "zipf") -> Unigram:
    if (path, scores) not in _MODELS:
        _MODELS[path, scores] = Unigram(path, scores)
    return _MODELS[path, scores]


def _encoded(path: str, scores: str, ids_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model(path, scores)
        byte = np.zeros(len(found.bytes) + 1, bool)
        byte[list(found.of_byte.values())] = True
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                ids = [found.encode(x) for x in texts]
                back = [found.decode(i) == (t or "") for t, i in zip(texts, ids)]
                wide = [np.frombuffer(x, "<u4") for x in ids]
                arrays = [part.column("id"), pa.array([len(x) for x in wide], pa.int64()), pa.array([int(byte[x].sum()) for x in wide], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(back, pa.bool_())]
                arrays.append(pa.array([x.astype(np.int32) if ids_too else None for x in wide], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None, scores: str = "zipf", id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Per row: n_pieces, n_byte_pieces, ids_crc32, round_trip and (unless off) the ids."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    out = rows.mapInArrow(_encoded(path, scores, ids), f"id {kind}, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, round_trip boolean, ids array<int>")
    return out.withColumnRenamed("id", id_col) if ids else out.withColumnRenamed("id", id_col).drop("ids")


def _decoded(path: str, scores: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model(path, scores)
        for batch in batches:
            texts = [None if x is None else found.decode(array("I", x).tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return run


def decode(rows: DataFrame, path: str | None = None, scores: str = "zipf", id_col: str = "doc_id") -> DataFrame:
    """Texts by ids; a null list gives a null text."""
    kind = rows.schema[id_col].dataType.simpleString()
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    return rows.select(F.col(id_col).alias("id"), "ids").mapInArrow(_decoded(path, scores), f"id {kind}, text string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ids=False)
