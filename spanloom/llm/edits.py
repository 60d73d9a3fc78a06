"""Operator 4: edit-aware token counts.

A document's pre-tokens are kept in a segment tree: leaves hold runs of up to LEAF
pre-tokens (length and number of tokens of each), every node the sums of its subtree.
An edit replaces characters [start, stop) by new text.  Only the touched region is
split and counted again, from the last pre-token that ends two characters before the
edit (a pre-token looks no further than that past its end) up to the first boundary
behind the edit that the old split shares: from there on both splits are equal, as the
splitting pattern looks at nothing before its start.  The tree is cut at both places,
the new leaves are put between, and sums change along the path alone.

Trees outlive a job as a table of leaf rows (`grow_trees`, `leaf_rows`); `edit_trees`
takes a table of edits, reads only the documents that it names, and gives the leaf rows
of all afterwards.

Token counts come from a byte-level BPE vocabulary; the count of each distinct
pre-token is remembered.

Defined results: a null text counts as empty; edits with null bounds or out of range
are clamped to the text, a null replacement deletes.  A document without edits has
equal counts.  Rows are handled one by one, so repeated rows and null ids pass
through; stored trees need an id, and keep the least text of a repeated one.  Edits of a
document apply in their order.  An empty table gives an empty result.  Further columns
are not read.  A text is held whole, its tree takes some ten times its size.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

LEAF = 32
#: pre-tokens of up to WORD characters whose counts a Python worker remembers
CACHE_WORDS = 1_000_000
WORD = 64
#: characters before an edit that a pre-token may have looked at
LOOK = 2


class Node:
    """A subtree: its characters, its tokens, and either a leaf's run or two children."""

    __slots__ = ("chars", "left", "right", "run", "tokens", "height")

    def __init__(self, run=None, left: "Node | None" = None, right: "Node | None" = None) -> None:
        self.run, self.left, self.right = run, left, right
        if run is None:
            self.chars, self.tokens = left.chars + right.chars, left.tokens + right.tokens
            self.height = 1 + max(left.height, right.height)
        else:
            self.chars, self.tokens = sum(n for n, _ in run), sum(t for _, t in run)
            self.height = 0


def build(run: list[tuple[int, int]]) -> Node | None:
    nodes = [Node(run[k : k + LEAF]) for k in range(0, len(run), LEAF)]
    while len(nodes) > 1:
        paired = [Node(None, *nodes[k : k + 2]) for k in range(0, len(nodes) - 1, 2)]
        nodes = paired + nodes[2 * len(paired) :]
    return nodes[0] if nodes else None


def join(a: Node | None, b: Node | None) -> Node | None:
    """Both sequences, one after the other; the tree stays balanced as AVL trees do."""
    if a is None or b is None:
        return b if a is None else a
    if a.height > b.height + 1:
        return _balanced(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return _balanced(join(a, b.left), b.right)
    return Node(None, a, b)


def _balanced(a: Node, b: Node) -> Node:
    if b.height > a.height + 1:
        if b.left.height > b.right.height:
            return Node(None, Node(None, a, b.left.left), Node(None, b.left.right, b.right))
        return Node(None, Node(None, a, b.left), b.right)
    if a.height > b.height + 1:
        if a.right.height > a.left.height:
            return Node(None, Node(None, a.left, a.right.left), Node(None, a.right.right, b))
        return Node(None, a.left, Node(None, a.right, b))
    return Node(None, a, b)


def cut(node: Node | None, chars: int) -> tuple[Node | None, Node | None]:
    """Split where the last pre-token that ends within `chars` characters ends."""
    if node is None or chars >= node.chars:
        return node, None
    if node.run is not None:
        total = k = 0
        while total + node.run[k][0] <= chars:
            total += node.run[k][0]
            k += 1
        return build(node.run[:k]), build(node.run[k:])
    if chars < node.left.chars:
        a, b = cut(node.left, chars)
        return a, join(b, node.right)
    a, b = cut(node.right, chars - node.left.chars)
    return join(node.left, a), b


def bounds(node: Node | None, at: int = 0) -> Iterator[int]:
    """Starts of the pre-tokens, in order, without walking further than asked for."""
    if node is None:
        return
    if node.run is not None:
        for n, _ in node.run:
            yield at
            at += n
    else:
        yield from bounds(node.left, at)
        yield from bounds(node.right, at + node.left.chars)


def leaves(node: Node | None) -> Iterator[list[tuple[int, int]]]:
    """The runs of all leaves, in order."""
    if node is not None:
        if node.run is not None:
            yield node.run
        else:
            yield from leaves(node.left)
            yield from leaves(node.right)


class EditedDocument:
    """A text with its token count, kept up to date under edits."""

    def __init__(self, text: str, split: "regex.Pattern", count: Callable[[str], int]) -> None:
        self.text, self.split, self.count = text, split, count
        self.tree = build([(len(m), count(m)) for m in split.findall(text)])
        self.recounted = 0

    @classmethod
    def restored(cls, text: str, run: list[tuple[int, int]], split: "regex.Pattern", count: Callable[[str], int]) -> "EditedDocument":
        """A document whose pre-tokens are known: none is split or counted."""
        found = cls("", split, count)
        found.text, found.tree = text, build(run)
        return found

    @property
    def tokens(self) -> int:
        return self.tree.tokens if self.tree else 0

    def edit(self, start: int, stop: int, new: str) -> None:
        size = len(self.text)
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        self.text = self.text[:start] + new + self.text[stop:]
        moved = len(new) - (stop - start)
        before, rest = cut(self.tree, max(0, start - LOOK))
        at = before.chars if before else 0
        old = (x + moved for x in bounds(rest, at) if x >= stop)
        goal, run = next(old, None), []
        for m in self.split.finditer(self.text, at):
            here = m.start()
            while goal is not None and goal < here:
                goal = next(old, None)
            if goal == here:
                break
            run.append((m.end() - here, self.count(m.group())))
            at = m.end()
            self.recounted += m.end() - here
        _, after = cut(rest, at - moved - (before.chars if before else 0)) if at < len(self.text) else (None, None)
        self.tree = join(join(before, build(run)), after)


class Counter:
    """Tokens of a pre-token by a tiktoken vocabulary file, remembered."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.encoding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def __call__(self, word: str) -> int:
        if len(word) > WORD:
            return len(self.encoding.encode_ordinary(word))
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = self.known[word] = len(self.encoding.encode_ordinary(word))
        return found


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


_OUT = "n_tokens bigint, n_edits bigint, n_chars_edited bigint, n_tokens_edited bigint, n_chars_recounted bigint"


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text, edits in zip(part.column("text").to_pylist(), part.column("edits").to_pylist()):
                    doc = EditedDocument(text or "", count.split, count)
                    first = doc.tokens
                    for e in edits or []:
                        if e is not None:
                            start = e["start"] or 0
                            doc.edit(start, start if e["stop"] is None else e["stop"], e["new"] or "")
                    rows.append((first, len(edits or []), len(doc.text), doc.tokens, doc.recounted))
                arrays = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *arrays], ["id", "n_tokens", "n_edits", "n_chars_edited", "n_tokens_edited", "n_chars_recounted"])

    return run


def count_edits(docs: DataFrame, edits, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts before and after the edits of every row.

    `edits` is a column array<struct<start, stop, new>>; they apply in order, each to the
    text that the ones before it have left.  Offsets count code points.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), edits.cast("array<struct<start:bigint,stop:bigint,new:string>>").alias("edits"))
    kind = rows.schema["id"].dataType.simpleString()
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return rows.mapInArrow(_counts(path), f"id {kind}, {_OUT}").withColumnRenamed("id", id_col)


_LEAVES = "array<struct<leaf:int,lengths:array<int>,counts:array<int>>>"


def _stored(path: str):
    """Apply the edits of every row to its stored tree, or split the text where none is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text, held, edits in zip(*(part.column(x).to_pylist() for x in ("text", "leaves", "edits"))):
                    if held is None:
                        doc = EditedDocument(text or "", count.split, count)
                        doc.recounted = len(doc.text)
                    else:
                        doc = EditedDocument.restored(text or "", [x for leaf in held for x in zip(leaf["lengths"], leaf["counts"])], count.split, count)
                    for e in edits or []:
                        if e is not None:
                            start = e["start"] or 0
                            doc.edit(start, start if e["stop"] is None else e["stop"], e["new"] or "")
                    kept = [{"leaf": k, "lengths": [n for n, _ in x], "counts": [t for _, t in x]} for k, x in enumerate(leaves(doc.tree))]
                    rows.append((doc.text, doc.tokens, doc.recounted, kept))
                text, tokens, recounted, kept = zip(*rows)
                kind = pa.list_(pa.struct([("leaf", pa.int32()), ("lengths", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))
                arrays = [part.column("id"), pa.array(text, pa.string()), pa.array(tokens, pa.int64()), pa.array(recounted, pa.int64()), pa.array(kept, kind)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "text", "n_tokens", "n_chars_recounted", "leaves"])

    return run


def _applied(rows: DataFrame, path: str | None) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = rows.select("id", "text", F.col("leaves").cast(_LEAVES).alias("leaves"), F.col("edits").cast("array<struct<start:bigint,stop:bigint,new:string>>").alias("edits"))
    return rows.mapInArrow(_stored(path), f"id {kind}, text string, n_tokens bigint, n_chars_recounted bigint, leaves {_LEAVES}")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row an id (the least of its texts); rows without an id go."""
    return docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(text_col).cast("string")).alias("text"))


def leaf_rows(trees: DataFrame) -> DataFrame:
    """(id, leaf, lengths, counts): the table that trees are stored as, a row a leaf."""
    return trees.select("id", F.explode("leaves").alias("l")).select("id", "l.*")


def grow_trees(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_tokens, n_chars_recounted, leaves) of every document, every text split once."""
    none = F.lit(None)
    return _applied(_documents(docs, id_col, text_col).withColumn("leaves", none).withColumn("edits", none), path)


def edit_lists(edits: DataFrame, order_col: str | None = None) -> DataFrame:
    """(id, edits): one list an id, its rows one after the other by `order_col`.

    Rows of equal order go by their edits.  Without an order column a repeated id is an
    error, as nothing says which row comes first.  Null lists are empty.
    """
    kind = "array<struct<start:bigint,stop:bigint,new:string>>"
    order = F.col(order_col) if order_col else F.lit(0)
    row = F.struct(order.alias("at"), F.coalesce(F.col("edits").cast(kind), F.array().cast(kind)).alias("edits"))
    rows = edits.where(F.col("id").isNotNull()).groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    lists = F.flatten(F.col("rows")["edits"])
    if not order_col:
        lists = F.when(F.size("rows") > 1, F.raise_error(F.lit("several rows of edits for one id need an order column")).cast(kind)).otherwise(lists)
    return rows.select("id", lists.alias("edits"))


def edit_trees(
    docs: DataFrame, stored: DataFrame, edits: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The edited documents, as by `grow_trees`, and the leaf rows of all documents afterwards.

    `stored` holds the leaf rows of the documents so far, `edits` (id, edits) lists of
    edits for some ids, all of which apply, those of one id by `order_col` (see
    `edit_lists`).  Only texts and leaves of those are read by Python, and only touched
    regions are split again; documents without stored leaves are split whole.
    """
    asked = edit_lists(edits, order_col)
    held = stored.join(asked.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("leaf", "lengths", "counts"))).alias("leaves"))
    touched = _documents(docs.join(asked.select(F.col("id").alias(id_col)), id_col, "left_semi"), id_col, text_col)
    done = materialize(_applied(touched.join(asked, "id").join(held, "id", "left"), path), "edited")
    return done, stored.join(done.select("id"), "id", "left_anti").select("id", "leaf", "lengths", "counts").unionByName(leaf_rows(done))


def routine_edits(text, source):
    """Three edits: the source as a first line, a middle stretch gone, the end rewritten."""
    size = F.coalesce(F.char_length(text), F.lit(0)).cast("bigint")
    head = F.concat(F.coalesce(source, F.lit("unknown")), F.lit("\n"))
    shift = F.char_length(head).cast("bigint")
    middle = shift + F.floor(size / 2)
    edit = lambda a, b, new: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("stop"), new.cast("string").alias("new"))
    left = shift + size - F.least(F.lit(24), size - F.floor(size / 2))
    return F.array(edit(F.lit(0), F.lit(0), head), edit(middle, middle + 24, F.lit("")), edit(left - 7, left, F.lit(" end.\n")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_edits(docs, routine_edits(F.col("text"), F.col("source")))
