"""Operator 13: alignment of two tokenizers by an associative monoid of fragments.

A text, a space in front, is encoded by a byte-level BPE (A) and by a SentencePiece model
(B).  Where tokens of both end, the text is cut into groups; all A-B token occurrences of
a group are linked.

Fragments: the tokens that end in a byte range (lo, hi] give an open prefix (up to the
first common end in the range), closed groups, and an open suffix (behind the last one);
a range without a common end is open as a whole.  `compose` puts neighbouring fragments
together and is associative, so a document of any length is cut into ranges of CHUNK bytes
that Spark deals to its tasks, and their fragments are composed by a tree of FAN children
a node, a shuffle a level.  Ranges are cut by bytes alone, through words and tokens.  What
a task encodes is the range widened to the units at both ends; a unit, which starts at a
blank where neither tokenizer ever joins what is before with what is behind, is encoded by
itself, and what units of up to UNIT_BYTES gave is remembered, up to CACHE_BYTES.  A short
document is one range and is put together from its units, whose ends are common ends.

Counts: every document holds its distinct linked id pairs and how often; their number of
documents is summed by Spark.  The table of pairs is bounded by the vocabularies; it is
broadcast in blocks of at most BLOCK_PAIRS, sums of a document over blocks add up.

Defined results: texts that are null, empty, or that a tokenizer does not give back byte
for byte (such as those with U+2581) have no tokens: zeros and ''.  Every row is a document
of its own, so repeated rows count as often as they come; null ids pass through.  An empty
table gives an empty result.  Further columns are not read.  A text is never cut short; a
stretch without blanks is one unit, which one task encodes, and the groups of a document
meet in one row in the end.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table, text_bytes

#: bytes of a range; longer documents are dealt out
CHUNK = 32 << 10
#: fragments that are composed at once
FAN = 8
#: units up to this size are remembered, until they and what they gave take CACHE_BYTES
UNIT_BYTES = 64
CACHE_BYTES = 128 << 20
#: id pairs that are broadcast at once
BLOCK_PAIRS = 2_000_000
#: links from which a group is taken by its distinct ids
LARGE = 4096
#: bytes of text that are looked up together
SLICE = 512 << 10

BLANK, NEWLINE = 0x20, 0x0A
#: bytes before or behind a cut that surely are no white space: visible ASCII; behind it, first bytes of characters too
_BEFORE = np.zeros(256, bool)
_BEFORE[0x21:0x7F] = True
_BEHIND = _BEFORE.copy()
_BEHIND[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


# ---------------------------------------------------------------- fragments


class Fragment(NamedTuple):
    """Tokens of a byte range.  If not `cut`, there is no common end: prefix_* holds all."""

    cut: bool
    prefix_a: np.ndarray
    prefix_b: np.ndarray
    closed: bytes
    n_groups: int
    n_links: int
    pairs: np.ndarray
    times: np.ndarray
    suffix_a: np.ndarray
    suffix_b: np.ndarray


_NO_IDS = np.empty(0, np.int32)
_NO_PAIRS = np.empty(0, np.int64)
#: the identity of `compose`
EMPTY = Fragment(False, _NO_IDS, _NO_IDS, b"", 0, 0, _NO_PAIRS, _NO_PAIRS, _NO_IDS, _NO_IDS)


def _group(a: np.ndarray, b: np.ndarray) -> bytes:
    return b"%s|%s" % (",".join(map(str, a.tolist())).encode(), ",".join(map(str, b.tolist())).encode())


def _links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs of a group (a << 32 | b), and how many links have them."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    return ((x.astype(np.int64) << 32)[:, None] | y).ravel(), (nx[:, None] * ny).ravel()


def _summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not pairs:
        return _NO_PAIRS, _NO_PAIRS
    found, at = np.unique(np.concatenate(pairs), return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, at, np.concatenate(times))
    return found, out


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """The fragment of a range from the ids of its tokens and where they end."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    if not len(common):
        return EMPTY._replace(prefix_a=a, prefix_b=b)
    last = [np.searchsorted(x, common, "right") for x in (a_ends, b_ends)]
    n = [np.diff(x) for x in last]
    first = [x[:-1] for x in last]
    # large groups by their distinct ids, all others link by link
    large = np.flatnonzero(n[0] * n[1] > LARGE)
    small = np.setdiff1d(np.arange(len(n[0])), large)
    i, j = _link_places(first[0][small], n[0][small], first[1][small], n[1][small])
    pair, times = np.unique(a[i].astype(np.int64) << 32 | b[j], return_counts=True)
    more = [_links(a[x : x + p], b[y : y + q]) for x, p, y, q in zip(*(v[large].tolist() for v in (first[0], n[0], first[1], n[1])))]
    found, times = _summed([pair, *(x for x, _ in more)], [times, *(t for _, t in more)])
    names = [list(map(str, x.tolist())) for x in (a, b)]
    at = [x.tolist() for x in last]
    closed = ";".join([f"{','.join(names[0][i:j])}|{','.join(names[1][k:m])}" for i, j, k, m in zip(at[0], at[0][1:], at[1], at[1][1:])]).encode()
    return Fragment(True, a[: at[0][0]], b[: at[1][0]], closed, len(n[0]), int((n[0] * n[1]).sum()), found, times, a[at[0][-1] :], b[at[1][-1] :])


def _link_places(first_a: np.ndarray, n_a: np.ndarray, first_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and the B token of every link of groups that start at first_* and have n_* tokens."""
    links = n_a * n_b
    of = np.repeat(np.arange(len(links)), links)
    k = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
    return first_a[of] + k // n_b[of], first_b[of] + k % n_b[of]


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two ranges that meet."""
    both = np.concatenate
    if not left.cut:
        return right._replace(prefix_a=both((left.prefix_a, right.prefix_a)), prefix_b=both((left.prefix_b, right.prefix_b)))
    if not right.cut:
        return left._replace(suffix_a=both((left.suffix_a, right.prefix_a)), suffix_b=both((left.suffix_b, right.prefix_b)))
    a, b = both((left.suffix_a, right.prefix_a)), both((left.suffix_b, right.prefix_b))
    own, times = _links(a, b)
    pairs, times = _summed([left.pairs, own, right.pairs], [left.times, times, right.times])
    closed = b";".join(x for x in (left.closed, _group(a, b), right.closed) if x)
    return Fragment(True, left.prefix_a, left.prefix_b, closed, left.n_groups + right.n_groups + 1, int(times.sum()), pairs, times, right.suffix_a, right.suffix_b)


# ---------------------------------------------------------------- encoding


def _byte_level() -> dict[str, int]:
    """Bytes by the characters that stand for them in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(others)}


def _ranked(path: str):
    """The same vocabulary as ranks, which encodes short texts faster; None if its merges do not rank as its ids do."""
    import tiktoken

    with open(path, encoding="utf-8") as lines:
        held = json.load(lines)
    names, of, model = held["model"]["vocab"], _byte_level(), held["model"]
    merges = ["".join(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
    ids = [names[x] for x in merges]
    plain = held["normalizer"] is None and held["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or model.get("ignore_merges") or ids != sorted(ids) or min(ids) < 256 or len(set(ids)) < len(ids):
        return None
    known = set(ids)
    ranks = {bytes([of[c] for c in x]): i for x, i in names.items() if i in known or len(x) == 1}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Units:
    """What distinct units give under both tokenizers, numbered as they come."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.ranked = _ranked(byte_path)
        self.b = SentencePieceProcessor(model_file=piece_path)
        names, of = self.a.get_vocab(), _byte_level()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes([of[x] for x in name]) if all(x in of for x in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        if any("\n" in x or "▁" in x.lstrip("▁") for x in pieces):
            raise ValueError("a piece goes across units")
        self.blank = self.b.piece_to_id("▁")
        #: ids in decimal, with the mark that may stand behind them
        self.names_a, self.names_b = (np.array([[b"%d%s" % (i, mark) for i in range(n)] for mark in marks], object) for n, marks in ((len(self.a_bytes), (b",", b"|")), (len(pieces), (b",", b";", b""))))
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.forget()

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.ranked:
            return list(map(self.ranked.encode_ordinary, texts))
        return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.text: list[bytes] = []
        self.good = np.empty(0, bool)
        #: ids, and pairs with times, of all units end to end; where each unit's start
        self.flat = [np.empty(0, np.int32), np.empty(0, np.int32), _NO_PAIRS, _NO_PAIRS]
        self.at = [np.zeros(1, np.int64) for _ in range(3)]
        self.counts = np.empty((0, 2), np.int64)
        self.bytes = 0

    def codes(self, units: pa.Array) -> np.ndarray:
        """Numbers of the units; new ones are learnt."""
        found = units.dictionary_encode()
        names = found.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter((self.known.get(x, -1) for x in names), np.int64, len(names))
        if len(new := np.flatnonzero(numbers < 0)):
            numbers[new] = np.arange(len(self.text), len(self.text) + len(new))
            self._learn(names[new].tolist())
        return numbers[found.indices.to_numpy()]

    def _learn(self, units: list[bytes]) -> None:
        base = len(self.text)
        self.known.update((x, base + k) for k, x in enumerate(units) if len(x) <= UNIT_BYTES)
        texts = [x.decode() for x in units]
        a = self.encode_a(texts)
        # B puts a blank in front: it stands for the unit's own, or goes again
        b = self.b.encode([x[1:] if x[0] == " " else x for x in texts], num_threads=1)
        b = [[self.blank] if x == " " else ids if x[0] == " " else ids[1:] for x, ids in zip(texts, b)]
        flat, sizes = zip(*(self._flat(x) for x in (a, b)))
        good, size = np.ones(len(units), bool), np.array([len(x) for x in units], np.int64)
        for ids, n, lengths, names in zip(flat, sizes, (self.a_size, self.b_size), (self.a_bytes, self.b_bytes)):
            held = np.concatenate(([0], np.cumsum(lengths[ids])))[np.concatenate(([0], np.cumsum(n)))]
            if not np.array_equal(np.diff(held), size) or b"".join(map(names.__getitem__, ids.tolist())) != b"".join(units):
                lists = np.split(ids, np.cumsum(n)[:-1])
                good &= np.array([b"".join([names[i] for i in x.tolist()]) == u for x, u in zip(lists, units)])
        if not good.all():
            flat, sizes = zip(*(self._flat([x if ok else [] for x, ok in zip(ids, good)]) for ids in (a, b)))
        ends = [np.cumsum(lengths[x]) for x, lengths in zip(flat, (self.a_size, self.b_size))]
        self._group(units, flat, sizes, [np.searchsorted(x, np.intersect1d(*ends, assume_unique=True), "right") for x in ends], good)

    @staticmethod
    def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.array(list(chain.from_iterable(ids)), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _group(self, units: list[bytes], flat: tuple, sizes: tuple, last: list[np.ndarray], good: np.ndarray) -> None:
        """Take in new units from their tokens, end to end, and where the tokens of their groups end."""
        a, b = flat
        n = [np.diff(x, prepend=0) for x in last]
        links = n[0] * n[1]
        i, j = _link_places(last[0] - n[0], n[0], last[1] - n[1], n[1])
        owner = np.repeat(np.arange(len(units)), sizes[0])
        unit, pair = owner[i], a[i].astype(np.int64) << 32 | b[j]
        order = np.lexsort((pair, unit))
        unit, pair = unit[order], pair[order]
        first = np.ones(len(pair), bool)
        first[1:] = (pair[1:] != pair[:-1]) | (unit[1:] != unit[:-1])
        heads = np.flatnonzero(first)
        times = np.diff(heads, append=len(pair))
        of_group = owner[last[0] - 1]
        groups = np.bincount(of_group, minlength=len(units))
        # A tokens of a group, then its B tokens, each with the mark behind it
        marks = [np.zeros(len(x), np.int64) for x in (a, b)]
        marks[0][last[0] - 1] = marks[1][last[1] - 1] = 1
        marks[1][(last[1] - 1)[np.cumsum(groups)[groups > 0] - 1]] = 2
        place = [np.arange(len(x)) + np.repeat(y, m) for x, y, m in zip((a, b), (np.cumsum(n[1]) - n[1], np.cumsum(n[0])), n)]
        text = np.empty(len(a) + len(b), object)
        text[place[0]], text[place[1]] = self.names_a[marks[0], a], self.names_b[marks[1], b]
        text, at = text.tolist(), np.concatenate(([0], np.cumsum(sizes[0] + sizes[1]))).tolist()
        self.text += [b"".join(text[x:y]) for x, y in zip(at, at[1:])]
        self.good = np.append(self.good, good)
        self.counts = np.concatenate((self.counts, np.stack((groups, np.bincount(of_group, links, len(units)).astype(np.int64)), axis=1)))
        self.at = [np.append(x, x[-1] + np.cumsum(s)) for x, s in zip(self.at, (*sizes, np.bincount(unit[heads], minlength=len(units))))]
        self.flat = [np.append(x, y) for x, y in zip(self.flat, (a, b, pair[heads], times))]
        self.bytes += sum(2 * len(x) + 200 for x in units) + 12 * (len(a) + len(b)) + 16 * len(heads)

    def gathered(self, which: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the flat arrays the entries of the units stand, and how many each has."""
        at = self.at[min(which, 2)]
        sizes = at[codes + 1] - at[codes]
        return np.arange(sizes.sum()) + np.repeat(at[codes] - (np.cumsum(sizes) - sizes), sizes), sizes


_UNITS: dict[tuple[str, str], Units] = {}


def units_of(paths: tuple[str, str]) -> Units:
    if paths not in _UNITS:
        _UNITS[paths] = Units(*paths)
    found = _UNITS[paths]
    if found.bytes > CACHE_BYTES:
        found.forget()
    return found


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where units start in texts that stand end to end and have a blank in front."""
    start = np.zeros(len(data), bool)
    start[at[:-1][np.diff(at) > 0]] = True
    blank, newline = data[1:] == BLANK, data[1:] == NEWLINE
    before = _BEFORE[data[:-1]]
    behind = np.append(_BEHIND[data[2:]], False)[: len(blank)]
    start[1:] |= blank & (data[:-1] != BLANK) & (before | behind) | newline & before
    return np.flatnonzero(start)


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def encoded(found: Units, stretch: bytes, base: int, lo: int, hi: int) -> tuple[Fragment, int, int, bool]:
    """Fragment of the tokens that end in (lo, hi] of the document, from a stretch of whole units at `base`.

    Also how many tokens of A and B these are, and whether all units came back.
    """
    data = np.frombuffer(stretch, np.uint8)
    codes = found.codes(_binary(data, cuts(data, np.array([0, len(data)]))))
    ids, ends = [], []
    for which, size in enumerate((found.a_size, found.b_size)):
        own = found.flat[which][found.gathered(which, codes)[0]]
        end = base + np.cumsum(size[own])
        inside = (end > lo) & (end <= hi)
        ids.append(own[inside])
        ends.append(end[inside])
    return fragment(ids[0], ends[0], ids[1], ends[1]), len(ids[0]), len(ids[1]), bool(found.good[codes].all())


def ranges(size: int, starts: np.ndarray, chunk: int = CHUNK) -> list[tuple[int, int, int, int]]:
    """Byte ranges (lo, hi) of a document and the stretch of whole units (from, to) that each needs.

    A bound that lies in the same unit as the one before it is left out.
    """
    bounds = np.arange(chunk, size, chunk)
    unit = np.searchsorted(starts, bounds, "right") - 1
    bounds = bounds[np.insert(np.diff(unit) > 0, 0, True)] if len(bounds) else bounds
    bounds = [0, *bounds.tolist(), size]
    edges = np.append(starts, size)
    first = edges[np.searchsorted(starts, bounds[:-1], "right") - 1].tolist()
    last = edges[np.searchsorted(edges, bounds[1:], "left")].tolist()
    return list(zip(bounds, bounds[1:], first, last))


_LISTS = {"prefix_a": pa.int32(), "prefix_b": pa.int32(), "pairs": pa.int64(), "times": pa.int64(), "suffix_a": pa.int32(), "suffix_b": pa.int32()}
_DONE = "uid bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, pairs array<bigint>, times array<bigint>"
_FRAGMENT = "uid bigint, chunk bigint, n_a bigint, n_b bigint, good boolean, cut boolean, " + ", ".join(f"{x} array<{'int' if t == pa.int32() else 'bigint'}>" for x, t in _LISTS.items()) + ", closed binary, n_groups bigint, n_links bigint"


def _list(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, kind))


def _read(paths: tuple[str, str], keep: bool, chunk: int):
    """Short documents are done at once; long ones come out as ranges with their stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                n, found = part.num_rows, units_of(paths)
                text = pc.fill_null(part.column("text"), "")
                some = pc.greater(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
                data, at = text_bytes(pc.if_else(pa.array(some), pc.binary_join_element_wise("", text, " "), ""))
                starts = cuts(data, at)
                short = np.diff(at) <= chunk
                unit = np.searchsorted(at, starts, "right") - 1
                mine = short[unit]
                names = _binary(data, starts).filter(pa.array(mine)) if len(starts) else pa.array([], pa.binary())
                codes, unit = found.codes(names) if len(names) else np.empty(0, np.int64), unit[mine]
                bad = np.zeros(n, bool)
                bad[unit[~found.good[codes]]] = True
                if bad.any():
                    codes, unit = codes[~bad[unit]], unit[~bad[unit]]
                done = short.nonzero()[0]
                rows = _whole(found, codes, unit, n, keep)
                uid = number + np.arange(n)
                number += n
                arrays = [pa.array(uid), part.column("id"), *rows]
                long, spans = np.flatnonzero(~short), []
                for d in long:
                    own = starts[np.searchsorted(starts, at[d]) : np.searchsorted(starts, at[d + 1])] - at[d]
                    spans.append([(lo, hi, x, data[at[d] + x : at[d] + y].tobytes()) for lo, hi, x, y in ranges(int(at[d + 1] - at[d]), own, chunk)])
                first = pa.RecordBatch.from_arrays(arrays, _NAMES).take(pa.array(done))
                yield _with(first, [[None] * 5] * len(done))
                for d, own in zip(long, spans):  # one row a range, written one by one
                    head = pa.RecordBatch.from_arrays(arrays, _NAMES).slice(int(d), 1)
                    for k, x in enumerate(own):
                        yield _with(head, [[k, *x]])

    return run


_NAMES = ["uid", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"]
_RANGE = ["chunk", "lo", "hi", "base", "stretch"]
_RANGES = "chunk bigint, lo bigint, hi bigint, base bigint, stretch binary"


def _with(rows: pa.RecordBatch, spans: list[list]) -> pa.RecordBatch:
    columns = list(zip(*spans)) or [[]] * 5
    arrays = [pa.array(x, pa.int64() if k < 4 else pa.binary()) for k, x in enumerate(columns)]
    return pa.RecordBatch.from_arrays([*rows.columns, *arrays], [*_NAMES, *_RANGE])


def _whole(found: Units, codes: np.ndarray, unit: np.ndarray, n: int, keep: bool) -> list[pa.Array]:
    """Results of n documents from the numbers of their units, in order, and the document of each."""
    totals = [np.bincount(unit, x[codes], n).astype(np.int64) for x in (*(np.diff(at) for at in found.at[:2]), *found.counts.T)] if len(codes) else [np.zeros(n, np.int64)] * 4
    at = np.searchsorted(unit, np.arange(n + 1)).tolist()
    pieces = list(map(found.text.__getitem__, codes.tolist()))
    groups = [b";".join(pieces[x:y]) for x, y in zip(at, at[1:])]
    # distinct units of a document first, then distinct pairs
    own, times = np.unique(unit << 32 | codes, return_counts=True)
    where, sizes = found.gathered(2, own & 0xFFFFFFFF)
    doc, pair, count = np.repeat(own >> 32, sizes), found.flat[2][where], found.flat[3][where] * np.repeat(times, sizes)
    order = np.lexsort((pair, doc))
    doc, pair, count = doc[order], pair[order], count[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
    heads = np.flatnonzero(first)
    count = np.add.reduceat(count, heads) if len(heads) else count
    at = pa.array(np.searchsorted(doc[heads], np.arange(n + 1)).astype(np.int32))
    digest = pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in groups], pa.string())
    kept = pa.array([x.decode() if keep else None for x in groups], pa.string())
    return [*map(pa.array, totals), digest, kept, pa.ListArray.from_arrays(at, pa.array(pair[heads])), pa.ListArray.from_arrays(at, pa.array(count, pa.int64()))]


def _rows(found: list[tuple]) -> pa.RecordBatch:
    """Rows of fragments: (uid, chunk, n_a, n_b, good, Fragment)."""
    uid, chunk, n_a, n_b, good, parts = zip(*found)
    arrays = [pa.array(x, pa.int64()) for x in (uid, chunk, n_a, n_b)] + [pa.array(good, pa.bool_()), pa.array([x.cut for x in parts], pa.bool_())]
    arrays += [_list([getattr(x, name) for x in parts], kind) for name, kind in _LISTS.items()]
    arrays += [pa.array([x.closed for x in parts], pa.binary()), pa.array([x.n_groups for x in parts], pa.int64()), pa.array([x.n_links for x in parts], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["uid", "chunk", "n_a", "n_b", "good", "cut", *_LISTS, "closed", "n_groups", "n_links"])


def _fragments(batch: "pa.RecordBatch | pa.Table") -> list[Fragment]:
    columns = {x: batch.column(x) for x in batch.schema.names}
    array = lambda name, k: columns[name][k].values.to_numpy(zero_copy_only=False)
    return [
        Fragment(
            columns["cut"][k].as_py(), array("prefix_a", k), array("prefix_b", k), columns["closed"][k].as_py(), columns["n_groups"][k].as_py(), columns["n_links"][k].as_py(),
            array("pairs", k), array("times", k), array("suffix_a", k), array("suffix_b", k),
        )
        for k in range(batch.num_rows)
    ]


def _ranged(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part, n_a, n_b, good = encoded(units_of(paths), row["stretch"], row["base"], row["lo"], row["hi"])
                yield _rows([(row["uid"], row["chunk"], n_a, n_b, good, part)])

    return run


def _composed(rows: pa.Table) -> pa.Table:
    """One fragment of all rows of a group, in the order of their ranges."""
    rows = rows.sort_by("chunk")
    whole = EMPTY
    for x in _fragments(rows):
        whole = compose(whole, x)
    total = lambda name: pc.sum(rows.column(name)).as_py()
    row = (rows.column("uid")[0].as_py(), rows.column("chunk")[0].as_py() // FAN, total("n_a"), total("n_b"), pc.all(rows.column("good")).as_py(), whole)
    return pa.Table.from_batches([_rows([row])])


def _ended(keep: bool):
    """Documents from the fragment of their whole range, whose end is a common end and whose start is one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, part in enumerate(_fragments(batch)):
                # a range of no tokens that ends where the document starts
                start = EMPTY._replace(cut=True)
                own, good = compose(start, part), batch.column("good")[k].as_py()
                own = own if good else EMPTY
                n = [batch.column(x)[k].as_py() if good else 0 for x in ("n_a", "n_b")]
                digest = hashlib.sha256(own.closed).hexdigest() if own.closed else ""
                arrays = [batch.column("uid").slice(k, 1), *(pa.array([x], pa.int64()) for x in (*n, own.n_groups, own.n_links)), pa.array([digest]), pa.array([own.closed.decode() if keep else None], pa.string())]
                yield pa.RecordBatch.from_arrays([*arrays, _list([own.pairs], pa.int64()), _list([own.times], pa.int64())], [x for x in _NAMES if x != "id"])

    return run


def aligned(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", groups: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Per row: uid, id, n_a, n_b, n_groups, n_links, groups_sha256, groups (null unless asked for), pairs and times.

    `groups` is the text `a1,a2|b1;a3|b2,b3`; `pairs` are the distinct linked id pairs as
    A id << 32 | B id, `times` their numbers of links.
    """
    paths = byte_path or public_tokenizers.path("byte_bpe_50k.json"), piece_path or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    done = _DONE.format(kind=kind)
    read = materialize(rows.mapInArrow(_read(paths, groups, chunk), f"{done}, {_RANGES}"), "read")
    short = read.where("chunk IS NULL").select(_NAMES)
    long = read.where("chunk IS NOT NULL").select("uid", *_RANGE)
    longest = long.agg(F.max("chunk")).first()[0]
    if longest is None:
        return short
    # the ranges of one document go to different tasks
    level = materialize(long.repartition("uid", "chunk").mapInArrow(_ranged(paths), _FRAGMENT), "fragments")
    while True:
        level = level.groupBy("uid", F.expr(f"chunk div {FAN}").alias("above")).applyInArrow(_composed, _FRAGMENT)
        level, longest = materialize(level, "fragments"), longest // FAN
        if not longest:
            break
    ends = level.mapInArrow(_ended(groups), done.replace(f", id {kind}", ""))
    ids = read.where("chunk = 0").select("uid", "id")
    return short.unionByName(ends.join(ids, "uid").select(_NAMES))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, docs, best): documents that hold a pair linked, and whether no other pair of its A id has more."""
    held = materialize(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pairs")
    most = held.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))
    out = held.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    return materialize(out, "counts")


def _weighed(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs, best = block.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            at = np.asarray(pairs.offsets).astype(np.int64)
            own, n = pairs.values.to_numpy()[at[0] : at[-1]], times.flatten().to_numpy()
            where = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            n = np.where(pair[where] == own, n, 0) if len(pair) else np.zeros(len(own), np.int64)
            where = where if len(pair) else np.zeros(0, np.int64)
            total = [np.concatenate(([0], np.cumsum(x))) for x in (n * best[where], n * docs[where])] if len(pair) else [np.zeros(len(own) + 1, np.int64)] * 2
            sums = [pa.array(x[at[1:] - at[0]] - x[at[:-1] - at[0]], pa.int64()) for x in total]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in batch.schema.names if x not in ("pairs", "times")] + sums, [x for x in batch.schema.names if x not in ("pairs", "times")] + ["n_best", "count_sum"])

    return run


def weighed(rows: DataFrame, counts: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """`rows` without pairs, with n_best and count_sum by the counts of all pairs."""
    spark, total = rows.sparkSession, counts.count()
    blocks = max(1, -(-total // block_pairs))
    parts = []
    for k in range(blocks):
        own = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k).toArrow().sort_by("pair")
        block = spark.sparkContext.broadcast(tuple(own.column(x).to_numpy() for x in ("pair", "docs", "best")))
        names = [x for x in rows.columns if x not in ("pairs", "times")] if blocks == 1 else ["uid"]
        kinds = ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in names)
        parts.append(rows.select(*names, "pairs", "times").mapInArrow(_weighed(block), f"{kinds}, n_best bigint, count_sum bigint"))
        if blocks > 1:
            parts[-1] = materialize(parts[-1], "weighed")
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    sums = every.groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "uid")


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", groups: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Per row: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups."""
    rows = aligned(docs, byte_path, piece_path, id_col, text_col, groups, chunk)
    out = weighed(rows, pair_counts(rows)).select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
    return out if groups else out.drop("groups")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), groups=False)
