"""Span trees of all traces at once.

Every span carries a pointer up and what is known of the way from below that pointer to
itself: numbers, flags or names, not the way itself.  Joining a span with the one it
points to doubles what it has covered, for all traces at once; a tree of depth d takes
log2(d) + 1 such joins, two a round.  Tables are placed by trace, so that rounds, siblings and
counts need no shuffle.  Pre-order comes from counting: spans below a span, then
those below its earlier siblings.  No task ever needs more than single spans of a trace.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.scan import scan, sum_before
from spanloom.sources.shared import bucketed, discard, materialize

#: how what is known of the upper part of a way and of the part below it become one
Fold = dict[str, Callable[[Column, Column], Column]]
#: number of spans on the way
STEPS: Fold = {"steps": lambda above, own: above + own}
#: whether anything on the way is marked
UNDER = lambda above, own: above | own
#: first and second span of the way
TOP: Fold = {"top": lambda above, own: F.struct(above["head"].alias("head"), F.coalesce(above["second"], own["head"]).alias("second"))}


def first_wins(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row of every key, by input order."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def _first_of_trace(rows: DataFrame) -> DataFrame:
    """`first_wins` by trace and span, its rows placed by trace."""
    behind = F.struct("span_id").eqNullSafe(F.lag(F.struct("span_id")).over(Window.partitionBy("trace_id").orderBy("span_id", "ord")))
    return rows.withColumn("_again", behind).where("NOT _again").drop("_again")


def occurrences(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Add `occurrence`: 1 for the first row of a key, 2 for the next."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


#: levels that the first round settles: two joins, each of which doubles
TOP_LEVELS = 4


def climb(state: DataFrame, fold: Fold, most_rounds: int = 40) -> DataFrame:
    """Follow `up` until nobody's points anywhere; rows that cannot get there are left out.

    state: trace_id, span_id, up and the columns of `fold`, which tell of the spans from
    just below `up` to the span itself.

    Pointers double, twice a round.  The table of a round is placed by trace, so its joins
    with itself shuffle nothing, and it takes the place of the one before.
    """
    folded = {c: F.when(F.col("met"), f(F.col(f"{c}2"), F.col(c))).otherwise(F.col(c)).alias(c) for c, f in fold.items()}

    def doubled(rows: DataFrame) -> DataFrame:
        above = rows.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.lit(True).alias("met"), *(F.col(c).alias(f"{c}2") for c in fold))
        # who is on top meets nobody; who meets nobody else leads nowhere
        return rows.join(above, ["trace_id", "up"], "left").where("up IS NULL OR met").select("trace_id", "span_id", F.col("up2").alias("up"), *folded.values())

    state = bucketed(state.select("trace_id", "span_id", "up", *fold), "tree")
    largest, rounds = None, 0
    while not state.where("up IS NOT NULL").isEmpty():
        if largest is None:
            largest = state.groupBy("trace_id").count().agg(F.max("count")).first()[0]
        if rounds >= min(most_rounds, largest.bit_length() + 1):
            break
        before, state = state, bucketed(doubled(doubled(state)), "tree")
        discard(before)
        rounds += 2
    return state.where("up IS NULL").drop("up")


def _top(head: str = "span_id") -> Column:
    """What `TOP` starts from."""
    return F.struct(F.col(head).alias("head"), F.lit(None).cast("string").alias("second")).alias("top")


def _step() -> Column:
    """What `STEPS` starts from."""
    return F.lit(1).cast("bigint").alias("steps")


def assemble_tree(spans: DataFrame, chains: bool = True, folded: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All spans below their trace's root, with `depth` and, if asked for, `chain`.

    The first parentless span of a trace is its root; the first of equal span ids
    counts; other roots, orphans, spans that are their own parent and cycles vanish with
    everything below them.  `chain` holds the span ids from the root down.  `folded` adds
    `collapsed` to the candidates before the way up is known, from what siblings tell;
    `under` then says whether a span or one above it is collapsed.
    """
    one = _first_of_trace(spans)
    root = F.min_by("span_id", F.when(F.col("parent_span_id").isNull(), F.col("ord"))).over(Window.partitionBy("trace_id"))
    one = one.withColumn("root_id", root).where("root_id IS NOT NULL AND (parent_span_id IS NOT NULL OR span_id = root_id)").where("parent_span_id IS NULL OR parent_span_id <> span_id")
    fold, starts = dict(STEPS), [_step()]
    if chains:
        fold["chain"] = F.concat
        starts.append(F.array("span_id").alias("chain"))
    if folded:
        one = folded(one)
        fold["under"] = UNDER
        starts.append(F.col("collapsed").alias("under"))
    one = bucketed(one.drop("root_id"), "spans")  # the way up is climbed by ids alone, then joined to it
    state = one.select("trace_id", "span_id", F.col("parent_span_id").alias("up"), *starts)
    found = climb(state, fold).withColumn("depth", (F.col("steps") - 1).cast("int")).drop("steps")
    return one.join(found, ["trace_id", "span_id"])


def ancestry(tree: DataFrame) -> DataFrame:
    """(trace_id, span_id, ancestor_id, distance) for every proper ancestor."""
    up = tree.select("trace_id", "span_id", "depth", F.posexplode("chain").alias("at", "ancestor_id"))
    return up.where("at < depth").select("trace_id", "span_id", "ancestor_id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def marked_ancestors(spans: DataFrame, marked: DataFrame) -> DataFrame:
    """(trace_id, span_id, ancestor_id) for proper ancestors in `marked` (trace_id, span_id).

    Parents are followed whether or not they lead to a root, so spans below orphans and on
    or below cycles count too.  Only traces with a marked span are read.
    """
    own = spans.join(marked.select("trace_id").distinct(), "trace_id", "left_semi")
    one = first_wins(own, ["trace_id", "span_id"]).select("trace_id", "span_id", F.col("parent_span_id").alias("up"))
    named = marked.select("trace_id", F.col("span_id").alias("up"), F.array("span_id").alias("above")).distinct()
    known = one.select("trace_id", F.col("span_id").alias("up"))
    linked = known.join(named, ["trace_id", "up"], "left").join(one, ["trace_id", "up"])
    state = linked.select("trace_id", "span_id", "up", F.coalesce("above", F.array().cast("array<string>")).alias("above"))
    state = materialize(state, "marked")
    largest = state.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    # finished rows stay in the table of the round that finished them
    done, todo = [], state
    for _ in range(largest.bit_length()):
        if todo.isEmpty():
            break
        ahead = reduce(DataFrame.unionByName, [*done, todo]).select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("above").alias("above2"))
        step = todo.join(ahead, ["trace_id", "up"], "left").select("trace_id", "span_id", F.col("up2").alias("up"), F.array_union("above", F.coalesce("above2", F.array().cast("array<string>"))).alias("above"))
        step = materialize(step, "marked")
        done, todo = [*done, step.where("up IS NULL")], step.where("up IS NOT NULL")
    found = reduce(DataFrame.unionByName, [*done, todo])
    return found.select("trace_id", "span_id", F.explode("above").alias("ancestor_id"))


def _descendants(inner: DataFrame) -> DataFrame:
    """(trace_id, id, below): how many rows hang below every row of a forest that has children.

    inner: trace_id, id, up, kids.  A round adds to a row what those 1, 2, 4, ... levels
    below have counted, and doubles their pointers.
    """
    state = bucketed(inner.select("trace_id", "id", "up", F.col("kids").alias("below")), "counts")
    while True:
        moving = state.where("up IS NOT NULL")
        if moving.isEmpty():
            return state.drop("up")
        more = moving.groupBy("trace_id", F.col("up").alias("id")).agg(F.sum("below").alias("more"))
        ahead = state.select("trace_id", F.col("id").alias("up"), F.col("up").alias("up2"))
        step = state.join(more, ["trace_id", "id"], "left").join(ahead, ["trace_id", "up"], "left")
        state = bucketed(step.select("trace_id", "id", F.col("up2").alias("up"), (F.col("below") + F.coalesce("more", F.lit(0))).alias("below")), "counts")


def preorder(tree: DataFrame, name: str = "position", order: tuple[str, ...] = ("started_ns", "ord"), id_col: str = "span_id") -> DataFrame:
    """Add the 0-based pre-order position within the trace, siblings in `order`.

    tree: trees of `assemble_tree`, whole or without some subtrees.  Rows with a null id
    have no children.  Rows below a row are counted, then those below its earlier siblings,
    and these counts add up from the root down; only rows with children take part in the
    rounds, and siblings of one parent may be any number.
    """
    tree = tree.withColumns({"id": F.col(id_col), "up": F.col("parent_span_id")})
    kids = bucketed(tree.where("up IS NOT NULL").groupBy("trace_id", "up").agg(F.count("*").alias("kids")), "kids")
    inner = tree.select("trace_id", "id", "up").join(kids.withColumnRenamed("up", "id"), ["trace_id", "id"])
    sized = tree.join(_descendants(inner), ["trace_id", "id"], "left").withColumn("size", 1 + F.coalesce("below", F.lit(0)))
    sized = scan(sized, ["trace_id", "up"], list(order), counts=kids.withColumnRenamed("kids", "count"), before=sum_before(F.col("size")))
    # a row comes one behind its parent, and behind all that hangs below its earlier siblings
    sized = bucketed(sized.withColumn("at", F.when(F.col("up").isNull(), F.lit(0)).otherwise(F.col("before") + 1).cast("bigint")), "sized")
    state = sized.where("below IS NOT NULL").select("trace_id", F.col("id").alias("span_id"), "up", "at")
    placed = climb(state, {"at": lambda above, own: above + own}).select("trace_id", F.col("span_id").alias("up"), F.col("at").alias("parent_at"))
    out = sized.join(placed, ["trace_id", "up"], "left").withColumn(name, F.col("at") + F.coalesce("parent_at", F.lit(0)))
    return out.select(*(c for c in tree.columns if c not in ("id", "up")), name)


def covered(tree: DataFrame, marked: DataFrame) -> DataFrame:
    """(trace_id, parent_span_id): spans with children that are in `marked` (trace_id, span_id) or below one that is."""
    parents = tree.select("trace_id", F.col("parent_span_id").alias("span_id")).distinct()
    flags = marked.select("trace_id", "span_id", F.lit(True).alias("flag")).distinct()
    state = tree.join(parents, ["trace_id", "span_id"], "left_semi").join(flags, ["trace_id", "span_id"], "left")
    state = state.select("trace_id", "span_id", F.col("parent_span_id").alias("up"), F.col("flag").isNotNull().alias("under"))
    found = climb(state, {"under": UNDER})
    return found.where("under").select("trace_id", F.col("span_id").alias("parent_span_id"))


def collapse_subtrees(tree: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Rows that stay visible when the spans in `collapsed` (trace_id, span_id) are folded."""
    return tree.join(covered(tree, collapsed), ["trace_id", "parent_span_id"], "left_anti")


def span_positions(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trace_id, span_id, depth, branch_span_id) of every span, and issues.

    Roots have depth 0 and branch ''.  An orphan counts as depth 0, is its own branch and
    gives an `orphan_span` issue.  Children of a depth-0 span are their own branch; what
    lies below inherits it.  Spans on or below a cycle are placed by `_cycles`.
    """
    one = bucketed(_first_of_trace(spans).select("trace_id", "span_id", "parent_span_id", "started_ns", "ended_ns"), "spans")
    ids = one.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("known"))
    linked = one.join(ids, ["trace_id", "parent_span_id"], "left")
    orphan = F.col("parent_span_id").isNotNull() & F.col("known").isNull()
    linked = linked.withColumn("orphan", orphan)
    up = F.when(~F.col("orphan"), F.col("parent_span_id"))
    found = climb(linked.select("trace_id", "span_id", up.alias("up"), _step(), _top()), {**STEPS, **TOP})
    heads = linked.where("orphan").select("trace_id", F.col("span_id").alias("head"), F.lit(True).alias("lost"))
    found = found.withColumn("head", F.col("top.head")).join(heads, ["trace_id", "head"], "left")
    branch = F.when(F.col("steps") > 1, F.col("top.second")).when(F.col("lost"), F.col("span_id")).otherwise(F.lit(""))
    placed = found.select("trace_id", "span_id", (F.col("steps") - 1).cast("int").alias("depth"), branch.alias("branch_span_id"))
    issues = linked.where("orphan").select("trace_id", F.lit("orphan_span").alias("code"), "span_id")
    rest = linked.join(placed, ["trace_id", "span_id"], "left_anti")
    rest = materialize(rest.select("trace_id", "span_id", "parent_span_id", "started_ns", "ended_ns"), "cycles")
    if not rest.isEmpty():
        more, found_issues = _cycles(rest)
        placed, issues = placed.unionByName(more), issues.unionByName(found_issues)
    return placed, issues


def _cycles(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Place spans on or below parent cycles.

    Of every cycle the entry is the span first reached from the earliest span (by start,
    end, id) that leads into it.  The span k parent steps from the entry has depth k
    (the entry: the cycle's length), what hangs below adds its distance, and the branch
    of them all is the span with k = 1.
    """
    # spans on cycles: those that peeling childless spans never removes
    on = rest.select("trace_id", "span_id", "parent_span_id")
    while True:
        parents = on.select("trace_id", F.col("parent_span_id").alias("span_id")).distinct()
        kept = materialize(on.join(parents, ["trace_id", "span_id"], "left_semi"), "ring")
        if kept.count() == on.count():
            break
        on = kept
    on = on.withColumnRenamed("parent_span_id", "next")
    # walk up from every span to the first span on a cycle: (span, gate, distance)
    ring = on.select("trace_id", "span_id", F.lit(True).alias("ring"))
    state = rest.join(ring, ["trace_id", "span_id"], "left").select(
        "trace_id", "span_id", F.when(F.col("ring").isNull(), F.col("parent_span_id")).alias("up"), _step(), _top()
    )
    gates = climb(state, {**STEPS, **TOP}).select("trace_id", "span_id", F.col("top.head").alias("gate"), (F.col("steps") - 1).alias("distance"))
    gates = materialize(gates.join(rest.select("trace_id", "span_id", "started_ns", "ended_ns"), ["trace_id", "span_id"]), "gates")
    # name every cycle by its smallest span, by pointer doubling over the ring
    name = materialize(on.select("trace_id", "span_id", "next", F.least("span_id", "next").alias("cycle")), "ring")
    longest = name.groupBy("trace_id").count().agg(F.max("count")).first()[0]
    for _ in range(longest.bit_length() + 1):
        ahead = name.select("trace_id", F.col("span_id").alias("next"), F.col("next").alias("next2"), F.col("cycle").alias("cycle2"))
        name = materialize(name.join(ahead, ["trace_id", "next"]).select("trace_id", "span_id", F.col("next2").alias("next"), F.least("cycle", "cycle2").alias("cycle")), "ring")
    name = name.select("trace_id", F.col("span_id").alias("gate"), "cycle")
    gates = gates.join(name, ["trace_id", "gate"])
    first = F.struct("started_ns", "ended_ns", "span_id")
    entry = gates.groupBy("trace_id", "cycle").agg(F.min_by("gate", first).alias("entry"))
    # number the ring: k parent steps from the entry; cut it before the entry and climb
    line = on.join(name.withColumnRenamed("gate", "span_id"), ["trace_id", "span_id"]).join(entry, ["trace_id", "cycle"])
    below = line.select("trace_id", F.col("next").alias("span_id"), F.when(F.col("span_id") != F.col("entry"), F.col("span_id")).alias("up"))
    steps = climb(below.select("trace_id", "span_id", "up", _step(), _top()), {**STEPS, **TOP})
    steps = steps.select("trace_id", F.col("span_id").alias("gate"), F.col("steps").alias("k"), F.col("top.head").alias("branch_span_id"))
    placed = gates.join(steps, ["trace_id", "gate"]).select("trace_id", "span_id", (F.col("k") + F.col("distance")).cast("int").alias("depth"), "branch_span_id")
    return placed, entry.select("trace_id", F.lit("parent_cycle").alias("code"), F.col("entry").alias("span_id"))
