"""Operator 11: exact Jaccard join of word n-gram sets by signature trees.

A document's set holds the 64-bit hashes of its distinct four-word shingles (words
lower-cased in A-Z; with fewer words, the whole sequence is the one shingle).  Documents
with equal sets are one node, named by their smallest id.

A signature tree keeps nodes of FAN children: the OR of their token bitmaps, the range of
their set sizes, and the most tokens by which a set outnumbers its own bits.  Two sets
under nodes A and B share at most popcount(A & B) tokens plus the smaller of those
excesses, and no more than the smaller set has.  Pairs of nodes whose bound is below what
the threshold asks of their smallest sets, or whose size ranges are too far apart, are
pruned with everything below them; so are pairs of nodes that hold one component alone.
The pairs of sets that the dual traversal reaches are confirmed by counting.  It finds a
forest of the links, enough to join all that links.

One tree of all sets would be one task, so sets are dealt to trees by an exact rule:

1. Tokens have one global order: hash order, tokens that many sets share last.  Sets that
   reach the threshold share a token among the first |x| - ceil(t |x|) + 1 of each.
2. The smallest node that has a token among its first ones is the token's hub.  All nodes
   with the token belong to the hub's group, so any two that may link meet in a group, and
   a family of near copies makes a few groups, not one for each of its tokens.
3. Groups of up to BLOCK members are sieved: trees of small bitmaps, about two bits a token,
   tell which members may have a partner at all.  Full sets travel for these alone.
4. A group is cut into blocks of bounded size, the hub in each; a block is a tree that is
   traversed against itself, first from the hub.  Links become components.
5. A group of several blocks that is not one component yet is traversed block against
   block, a task a pair of blocks.  No pair is ever a row.

Which tokens go last decides the work alone, never the result: repeats are counted in runs
of RUN tokens of a task, those seen more than HOT times go last.

Defined results: null and blank texts have the empty set, link with nothing and are
their own component.  Rows that repeat a doc_id stand for one document.  A row with a
null doc_id takes no part: component_id null.  An empty table gives an empty result.
Further columns are not read.  Shingles are compared by 64-bit hashes, equal sets by 128.
Ties (which of several links joins two groups) do not change a component.  A long text is
hashed whole and takes some thirty times its size while it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table
from .dedup import BROADCAST_IDS, components, merged, set_keys, shingle_sets, spread

SHINGLE = 4
PERCENT = 85
#: children of a node; bits of a bitmap for each token of the largest set, fewest and most of them
FAN = 4
SPREAD = 32
BITS = 256, 16384
#: members and shingles of a block at most (one document may hold more)
BLOCK = 2048
BLOCK_SHINGLES = 500_000
#: node pairs, and bits, that are looked at together
TOGETHER = 4096
GRID = 1 << 22
#: tokens that are counted together; sets that share a token from which it goes last; such tokens at most
RUN = 4_000_000
HOT = 50
MOST_HOT = 500_000
#: tokens below this are counted: the first ones of a set lie there
LOW = np.uint64(1 << 62)


# ---------------------------------------------------------------- signature trees


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A bitmap of so many bits for every set, a row each: the lowest bits of its tokens."""
    sizes = np.array([len(x) for x in sets], np.int64)
    bit = (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64)
    owner, at = np.repeat(np.arange(len(sets)), sizes), np.concatenate(([0], np.cumsum(sizes)))
    maps, step = np.empty((len(sets), bits // 64), np.uint64), max(1, GRID // bits)
    for lo in range(0, len(sets), step):
        hi = min(lo + step, len(sets))
        grid = np.zeros((hi - lo, bits), bool)
        grid[owner[at[lo] : at[hi]] - lo, bit[at[lo] : at[hi]]] = True
        maps[lo:hi] = np.packbits(grid, axis=1, bitorder="little").view("<u8")
    return maps


class Tree:
    """A signature tree; level 0 are the sets, FAN nodes of a level make one of the next."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, depth: int) -> None:
        self.levels = [(maps, sizes, sizes, sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        for _ in range(depth):
            maps, low, high, excess = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))


def possible(a: tuple, b: tuple, percent: int) -> np.ndarray:
    """Whether nodes of two levels (arrays row by row) may hold sets that are similar enough."""
    (maps_a, low_a, high_a, excess_a), (maps_b, low_b, high_b, excess_b) = a, b
    most = np.bitwise_count(maps_a & maps_b).sum(axis=1, dtype=np.int64) + np.minimum(excess_a, excess_b)
    most = np.minimum(most, np.minimum(high_a, high_b))
    near = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    return near & ((100 + percent) * most >= percent * (low_a + low_b))


class Traversal:
    """Visits the pairs of sets, or of the first `split` with the others, that no pair of nodes above rules out."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, percent: int, split: int = 0) -> None:
        self.percent, self.split, self.looked = percent, split, 0
        sides = [slice(0, split), slice(split, None)] if split else [slice(None)]
        self.depth = 0
        while FAN**self.depth < max(len(sizes[x]) for x in sides):
            self.depth += 1
        self.trees = [Tree(maps[x], sizes[x], self.depth) for x in sides]

    def settled(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether nothing below these pairs of nodes needs a look."""
        raise NotImplementedError

    def leaves(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of sets that may be similar enough."""
        raise NotImplementedError

    def _pruned(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        open_ = ~self.settled(level, i, j)
        i, j = i[open_], j[open_]
        self.looked += len(i)
        keep = possible(tuple(x[i] for x in self.trees[0].levels[level]), tuple(x[j] for x in self.trees[-1].levels[level]), self.percent)
        return i[keep], j[keep]

    def _children(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children, one level down."""
        a = (FAN * i[:, None, None] + np.arange(FAN)[None, :, None] + np.zeros((1, 1, FAN), np.int64)).ravel()
        b = (FAN * j[:, None, None] + np.arange(FAN)[None, None, :] + np.zeros((1, FAN, 1), np.int64)).ravel()
        real = (a < len(self.trees[0].levels[level][1])) & (b < len(self.trees[-1].levels[level][1]))
        if not self.split:
            real &= (a <= b) if level else (a < b)
        return a[real], b[real]

    def _visit(self, level: int, i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, len(i), TOGETHER):
            x, y = self._pruned(level, i[at : at + TOGETHER], j[at : at + TOGETHER])
            if level == 0:
                self.leaves(x, y)
                continue
            step = TOGETHER // FAN**2
            for k in range(0, len(x), step):
                self._visit(level - 1, *self._children(level - 1, x[k : k + step], y[k : k + step]))

    def traverse(self) -> None:
        top = [np.arange(len(t.levels[self.depth][1])) for t in (self.trees[0], self.trees[-1])]
        if self.depth or self.split:
            self._visit(self.depth, np.repeat(top[0], len(top[1])), np.tile(top[1], len(top[0])))


class Sieve(Traversal):
    """Which sets may have a partner at all, by their bitmaps alone; a pair of nodes all marked is settled."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, percent: int, marked: np.ndarray, split: int = 0) -> None:
        super().__init__(maps, sizes, percent, split)
        self.marked = marked

    def settled(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        sides = [self.marked[: self.split or None], self.marked[self.split :]]
        one, two = (np.logical_and.reduceat(x, np.arange(0, len(x), FAN**level)) for x in sides)
        return one[i] & two[j]

    def leaves(self, i: np.ndarray, j: np.ndarray) -> None:
        self.marked[i] = self.marked[j + self.split] = True


def sieved(sizes: np.ndarray, maps: list[bytes], percent: int) -> np.ndarray:
    """Which of the sets may be similar enough to another, by bitmaps of `width_of` their sizes.

    Similar sets have bitmaps of equal or of neighbouring widths; the wider are folded.
    """
    out = np.zeros(len(sizes), bool)
    widths = np.array([len(x) for x in maps])
    for width in np.unique(widths):
        own, next_ = (np.flatnonzero(widths == x) for x in (width, 2 * width))
        own = own[np.argsort(sizes[own], kind="stable")]
        rows = np.frombuffer(b"".join([maps[k] for k in own]), "<u8").reshape(len(own), -1)
        if len(own) > 1:
            one = Sieve(rows, sizes[own], percent, out[own])
            one.traverse()
            out[own] |= one.marked
        next_ = next_[np.argsort(sizes[next_], kind="stable")]
        next_ = next_[100 * sizes[own].max() >= percent * sizes[next_]]
        if len(next_):
            wide = np.frombuffer(b"".join([maps[k] for k in next_]), "<u8").reshape(len(next_), 2, -1)
            both = np.concatenate((own, next_))
            one = Sieve(np.concatenate((rows, wide[:, 0] | wide[:, 1])), sizes[both], percent, out[both], len(own))
            one.traverse()
            out[both] |= one.marked
    return out


def width_of(n: int) -> int:
    """Bits of the bitmap that travels with a set of n."""
    return max(BITS[0], 1 << int(2 * n - 1).bit_length())


class Join(Traversal):
    """Links among sets, or between the first `split` of them and the others, as a forest over labels."""

    def __init__(self, sets: list[np.ndarray], labels: list, percent: int, split: int = 0) -> None:
        _, group = np.unique(np.array(labels), return_inverse=True)
        sizes = np.array([len(x) for x in sets], np.int64)
        key = np.array([x[0] for x in sets], np.uint64)
        # like sets side by side, the two sides apart
        self.order = np.lexsort((key, sizes, group, np.arange(len(sets)) >= split))
        self.sets, self.group = [sets[k] for k in self.order], group[self.order].astype(np.int64)
        bits = int(np.clip(1 << int(SPREAD * sizes.max() - 1).bit_length(), *BITS))
        super().__init__(bitmaps(self.sets, bits), sizes[self.order], percent, split)
        self.links: list[tuple[int, int]] = []
        self.uniform: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _labels(self, side: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest label below the nodes of a level."""
        if (side, level) not in self.uniform:
            own = self.group[self.split :] if side else self.group[: self.split or None]
            at = np.arange(0, len(own), FAN**level)
            self.uniform[side, level] = np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)
        return self.uniform[side, level]

    def settled(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (low, high), (low2, high2) = self._labels(0, level), self._labels(len(self.trees) - 1, level)
        return (low[i] == high[i]) & (low2[j] == high2[j]) & (low[i] == low2[j])

    def leaves(self, i: np.ndarray, j: np.ndarray) -> None:
        """Count what pairs of sets share, and join those that are similar enough."""
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order] + self.split
        heads = np.flatnonzero(np.diff(i, prepend=-1))
        for x, lo, hi in zip(i[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(i)]):
            others = j[lo:hi][self.group[j[lo:hi]] != self.group[x]]
            if not len(others):
                continue
            own = self.sets[x]
            at = np.cumsum([0, *(len(self.sets[y]) for y in others)])
            token = np.concatenate([self.sets[y] for y in others])
            held = np.concatenate(([0], np.cumsum(own[np.minimum(np.searchsorted(own, token), len(own) - 1)] == token)))
            shared, sizes = held[at[1:]] - held[at[:-1]], np.diff(at)
            for y in others[100 * shared >= self.percent * (len(own) + sizes - shared)].tolist():
                if self.group[y] != self.group[x]:
                    self.group[self.group == self.group[y]] = self.group[x]
                    self.links.append((int(self.order[x]), int(self.order[y])))
                    self.uniform.clear()

    def found(self, hub: int | None = None) -> list[tuple[int, int]]:
        """Links by the positions of their sets, those of the set `hub` first."""
        if hub is not None:
            own = int(np.flatnonzero(self.order == hub)[0])
            near = np.arange(len(self.trees[0].levels[self.depth][1]))
            for level in range(self.depth, -1, -1):
                if level < self.depth:
                    near = (FAN * near[:, None] + np.arange(FAN)).ravel()
                    near = near[near < len(self.trees[0].levels[level][1])]
                one = tuple(x[np.full(len(near), own)] for x in self.trees[0].levels[0])
                near = near[possible(one, tuple(x[near] for x in self.trees[0].levels[level]), self.percent)]
            self.leaves(np.full(len(near), own), near)
        self.traverse()
        return self.links


# ---------------------------------------------------------------- which sets meet


def first_tokens(n: int, percent: int) -> int:
    """How many first tokens of a set of n share one with those of every set that is similar enough."""
    return n + (-percent * n // 100) + 1 if n else 0


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens that several sets of a run hold, and how many do."""
    held: list[np.ndarray] = []
    keys: set[tuple[int, int]] = set()
    size = 0

    def counted() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1])], ["token", "seen"])

    for batch in batches:
        for part in slices(batch):
            values, at = shingle_sets(part.column("text"), SHINGLE)
            for k, key in enumerate(zip(*(x.tolist() for x in set_keys(values, at)))):
                if key not in keys:
                    keys.add(key)
                    own = values[at[k] : at[k + 1]]
                    held.append(own[: np.searchsorted(own, LOW)].copy())
                    size += len(held[-1])
            if size > RUN:
                yield counted()
                held, keys, size = [], set(), 0
    if held:
        yield counted()


def _sketches(percent: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = hot.value
        for batch in batches:
            for part in slices(batch):
                values, at = shingle_sets(part.column("text"), SHINGLE)
                hi, lo = set_keys(values, at)
                late = np.zeros(len(values), bool)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, values), len(last) - 1)] == values
                firsts, maps = [], []
                for x, y in zip(at.tolist(), at[1:].tolist()):
                    own, want = values[x:y], first_tokens(y - x, percent)
                    maps.append(bitmaps([own], width_of(y - x))[0].astype("<u8").tobytes())
                    early = own[~late[x:y]][:want]
                    firsts.append(early if len(early) == want else np.concatenate((early, own[late[x:y]][: want - len(early)])))
                ends = pa.array(np.cumsum([0, *map(len, firsts)], dtype=np.int32))
                tokens = np.concatenate(firsts).view(np.int64) if firsts else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(at)), pa.array(hi), pa.array(lo), pa.ListArray.from_arrays(ends, pa.array(tokens)), pa.array(maps, pa.binary())], ["id", "n_shingles", "hi", "lo", "tokens", "bitmap"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            values, at = shingle_sets(part.column("text"), SHINGLE)
            rows = [values[x:y].tobytes() for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(at)), pa.array(rows, pa.binary())], ["node", "n", "members"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """The rows of each key, of rows that are sorted by it."""
    now, held = None, []
    for batch in batches:
        names, at = list(zip(*(batch.column(x).to_pylist() for x in keys))), 0
        for k in range(len(names) + 1):
            if k == len(names) or names[k] != now:
                if k > at:
                    held.append(batch.slice(at, k - at))
                if k == len(names):
                    break
                if held:
                    yield now, held
                now, held, at = names[k], [], k
    if held:
        yield now, held


def _sieved(percent: int):
    """Rows of groups of bounded size without members that can have no partner there; large groups as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, ["hub"]):
            rows = pa.Table.from_batches(rows)
            sizes = rows.column("n").to_numpy()
            keep = sieved(sizes, rows.column("bitmap").to_pylist(), percent)
            for batch in rows.select(["hub", "node", "n"]).filter(pa.array(keep)).to_batches():
                yield batch

    return run


def _within(percent: int):
    """Links of every block, which is a tree, starting from its hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hub, _), rows in _runs(batches, ["hub", "block"]):
            rows = pa.Table.from_batches(rows)
            nodes = rows.column("node").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("members").to_pylist()]
            links = Join(sets, list(range(len(nodes))), percent).found(nodes.index(hub) if hub in nodes else None)
            yield _pairs([(nodes[a], nodes[b]) for a, b in links], rows.schema.field("node").type)

    return run


def _across(percent: int):
    """Links between the two blocks of every cell, across labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _runs(batches, ["hub", "i", "j"]):
            rows = pa.Table.from_batches(rows).sort_by([("own", "ascending"), ("node", "ascending")])
            nodes, own = rows.column("node").to_pylist(), rows.column("own").to_pylist()
            if i in own and j in own:
                sets = [np.frombuffer(x, np.uint64) for x in rows.column("members").to_pylist()]
                links = Join(sets, rows.column("label").to_pylist(), percent, own.index(j)).found()
                yield _pairs([(nodes[a], nodes[b]) for a, b in links], rows.schema.field("node").type)

    return run


def _pairs(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k in (0, 1)], ["a", "b"])


def hot_tokens(texts: DataFrame) -> np.ndarray:
    """The tokens that go last, sorted: at most MOST_HOT, the most frequent ones."""
    seen = materialize(texts.mapInArrow(_repeats, "token bigint, seen bigint").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") > HOT), "repeats")
    least = HOT
    while seen.where(F.col("seen") > least).count() > MOST_HOT:
        least *= 2
    found = seen.where(F.col("seen") > least).select("token").toArrow().column("token").to_numpy()
    return np.sort(found.view(np.uint64))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles, component_id; links are pairs with a similarity of `percent` or more."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    hot = docs.sparkSession.sparkContext.broadcast(hot_tokens(texts.select("text")))
    every = materialize(texts.mapInArrow(_sketches(percent, hot), f"id {kind}, n_shingles bigint, hi bigint, lo bigint, tokens array<bigint>, bitmap binary"), "sketches")
    classes = every.where("n_shingles > 0 AND id IS NOT NULL").groupBy("hi", "lo").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    # a repeated id may stand in a table twice with one set
    nodes = every.join(classes.select("hi", "lo", F.col("node").alias("id")), ["hi", "lo", "id"]).dropDuplicates(["hi", "lo"])
    nodes = materialize(nodes.select(F.col("id").alias("node"), F.col("n_shingles").alias("n"), "tokens", "bitmap"), "nodes")
    rows = nodes.select("node", F.explode("tokens").alias("token"))
    hubs = rows.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub < other").select("token", "hub")
    around = materialize(rows.join(hubs, "token").select("hub", "node").distinct(), "groups")

    # groups that fit one tree are sieved by bitmaps before sets travel
    counts = around.groupBy("hub").agg(F.count("*").alias("c"))
    around = around.join(counts, "hub").withColumn("fits", F.col("c") <= BLOCK)
    large = around.where("NOT fits").join(nodes.select("node", "n"), "node").select("hub", "node", "n")
    small = around.where("fits").select("hub", "node").join(nodes.select("node", "n", "bitmap"), "node")
    small = small.repartition("hub").sortWithinPartitions("hub").mapInArrow(_sieved(percent), f"hub {kind}, node {kind}, n bigint")
    around = materialize(large.unionByName(small), "groups")

    ids = materialize(around.select("node").distinct(), "active")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    own = texts.join(ids, texts.id == ids.node, "left_semi")
    active = materialize(own.mapInArrow(_sets, f"node {kind}, n bigint, members binary"), "sets")

    sizes = around.groupBy("hub").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    dealt = around.join(sizes.select("hub", blocks.alias("k")), "hub").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = materialize(dealt, "dealt")
    # the hub is in every block
    places = F.when(F.col("hub") == F.col("node"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array("own"))
    work = dealt.select("hub", "node", F.explode(places).alias("block")).join(active.select("node", "members"), "node")
    work = work.repartition("hub", "block").sortWithinPartitions("hub", "block")
    links = materialize(work.mapInArrow(_within(percent), f"a {kind}, b {kind}").distinct(), "links")
    labels = components(links)

    wide = dealt.where("k > 1").join(labels, "node", "left").select("hub", "node", "k", "own", F.coalesce("label", "node").alias("label"))
    wide = materialize(wide, "wide")
    mixed = wide.groupBy("hub").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("hub")
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda x: x != F.col("own")), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    cells = wide.join(mixed, "hub").select("hub", "node", "label", "own", F.explode(others).alias("cell")).select("hub", "node", "label", "own", "cell.*")
    cells = cells.join(active.select("node", "members"), "node").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    more = materialize(cells.mapInArrow(_across(percent), f"a {kind}, b {kind}").distinct(), "links")
    if not more.isEmpty():
        labels = merged(labels, more)
    return spread(every.drop("tokens", "bitmap"), classes, labels).select(F.col("id").alias(id_col), "n_shingles", F.col("own").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * shared.n >= 85 * (s.n + t.n - shared.n)
),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM reached r LEFT JOIN sizes s USING (doc_id) GROUP BY r.doc_id
"""
