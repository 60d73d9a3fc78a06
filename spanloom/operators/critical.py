"""Critical paths of all build graphs at once.

Nodes are (trace_id, unit); edges say which units a unit unblocks.  Spans are placed by
trace once, and graphs of up to SMALL spans, which are nearly all, are solved where they
lie, many in one step (`small_graphs`).  Larger ones are all worked
on in the same joins: a round peels the units whose predecessors are all known, and
chains of units are contracted by pointer doubling, so that rounds grow with the
branching of the deepest graph, not with its length.  Cycles are strongly connected
components.  Paths are walked back in rounds that double.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import scalars as S
from spanloom.operators import small_graphs
from spanloom.operators.tree import occurrences
from spanloom.sources.shared import bucketed, discard, materialize


def build_graph(spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units, edges and issues from (trace_id, span_id, ord, duration_ns, unit_text, unblocks_text).

    The first span of a unit owns it; later ones are `duplicate_unit` and their edges are
    ignored.  Bad tokens are `invalid_unblocks`, edges of a span without a valid unit
    `unblocks_without_unit`, absent targets `missing_unit`.
    """
    good, bad = S.parse_unblocks(F.col("unblocks_text"))
    rows = spans.withColumn("unit", S.parse_unit(F.col("unit_text"))).withColumn("targets", good).withColumn("bad", bad)
    rows = materialize(rows, "units")
    none = F.lit(None).cast("int")
    issue = lambda df, code, unit: df.select("trace_id", F.lit(code).alias("code"), "span_id", unit.alias("unit"))
    with_unit = occurrences(rows.where("unit IS NOT NULL"), ["trace_id", "unit"])
    owners = with_unit.where("occurrence = 1")
    units = materialize(owners.select("trace_id", "unit", "span_id", "duration_ns"), "owners")
    edges = owners.select("trace_id", "span_id", F.col("unit").alias("src"), F.explode("targets").alias("dst"))
    known = units.select("trace_id", F.col("unit").alias("dst"))
    issues = [
        issue(rows.where("unit_text IS NOT NULL AND unit IS NULL"), "invalid_unit", none),
        issue(with_unit.where("occurrence > 1"), "duplicate_unit", F.col("unit")),
        issue(rows.where("unit IS NULL AND unblocks_text IS NOT NULL"), "unblocks_without_unit", none),
        issue(owners.where("size(bad) > 0"), "invalid_unblocks", F.col("unit")),
        issue(edges.join(known, ["trace_id", "dst"], "left_anti"), "missing_unit", F.col("dst")),
        issue(edges.where("src = dst"), "cycle", F.col("src")),
    ]
    edges = edges.join(known, ["trace_id", "dst"], "left_semi").select("trace_id", "src", "dst").distinct()
    return units, edges, reduce(DataFrame.unionByName, issues)


#: peels before chains are looked for: shallow graphs need no more, deep ones often are chains
PLAIN_PEELS = 4


def finish_times(units: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trace_id, unit, finish, pred) of the longest chain into every unit, and what is on or behind a cycle.

    Of equally long chains the one through the smallest predecessor counts.

    A link says what its source adds to its target: max(floor, finish + gain).  A round
    peels the units whose predecessors are all known; before a peel, chains are contracted
    into single links (`_contracted`), so a long line of units takes few rounds.
    """
    edges = materialize(edges.where("src <> dst"), "edges")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    links = edges.select("trace_id", "src", "dst", zero.alias("gain"), none.alias("floor"))
    degree = edges.groupBy("trace_id", F.col("dst").alias("unit")).agg(F.count("*").alias("open"))
    state = units.select("trace_id", "unit", "duration_ns").join(degree, ["trace_id", "unit"], "left")
    state = materialize(state.select("trace_id", "unit", "duration_ns", F.coalesce("open", zero).alias("open"), zero.alias("best")), "open")
    solved, inner, peels = [], [], 0
    while True:
        # the units that a round makes ready stay in the table of that round
        ready = state.where("open = 0").select("trace_id", "unit", (F.col("best") + F.col("duration_ns")).alias("finish"))
        solved.append(ready)
        if ready.isEmpty():
            break
        if peels >= PLAIN_PEELS and not state.where("open > 0").isEmpty():
            state, links, removed = _contracted(state, links)
            if removed is not None:
                inner.append(removed)
                # what was ready before the contraction still is, and counts once
                solved[-1] = state.where("open = 0").select("trace_id", "unit", (F.col("best") + F.col("duration_ns")).alias("finish"))
        sent = solved[-1].withColumnRenamed("unit", "src").join(links, ["trace_id", "src"])
        sent = sent.groupBy("trace_id", F.col("dst").alias("unit")).agg(F.count("*").alias("got"), F.max(F.greatest("floor", F.col("finish") + F.col("gain"))).alias("top"))
        rest = state.where("open > 0").join(sent, ["trace_id", "unit"], "left")
        state = materialize(rest.select("trace_id", "unit", "duration_ns", (F.col("open") - F.coalesce("got", zero)).alias("open"), F.greatest("best", "top").alias("best")), "open")
        peels += 1
    finish = materialize(reduce(DataFrame.unionByName, solved), "finish")
    for removed in reversed(inner):
        start = finish.select("trace_id", F.col("unit").alias("start"), F.col("finish").alias("begun"))
        own = removed.join(start, ["trace_id", "start"]).select("trace_id", "unit", F.greatest("floor", F.col("begun") + F.col("gain")).alias("finish"))
        finish = materialize(finish.unionByName(own), "finish")
    before = edges.join(finish.withColumnRenamed("unit", "src"), ["trace_id", "src"])
    before = before.groupBy("trace_id", F.col("dst").alias("unit")).agg(F.max(F.struct("finish", (-F.col("src")).alias("neg"))).alias("top"))
    known = finish.join(before.select("trace_id", "unit", (-F.col("top.neg")).cast("int").alias("pred")), ["trace_id", "unit"], "left")
    residue = units.select("trace_id", "unit").join(finish.select("trace_id", "unit"), ["trace_id", "unit"], "left_anti")
    return materialize(known, "known"), residue


def _chained(state: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that leave an unsolved unit, and the units with one such link in and one out."""
    alive = links.join(state.select("trace_id", F.col("unit").alias("src")), ["trace_id", "src"], "left_semi")
    alive = materialize(alive, "alive")
    single = lambda side: alive.groupBy("trace_id", F.col(side).alias("unit")).agg(F.count("*").alias("n")).where("n = 1").select("trace_id", "unit")
    chained = state.join(single("src"), ["trace_id", "unit"], "left_semi").join(single("dst"), ["trace_id", "unit"], "left_semi")
    return alive, materialize(chained, "chained")


def _contracted(state: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """State and links without the units with one link in and one out, and those units.

    Such a unit's finish is max(floor, finish of `start` + gain), where `start` is the unit
    before its chain; pointers to it double, twice a round.  Rings of such units are left out of all three:
    nothing ever solves them.
    """
    alive, chained = _chained(state, links)
    if chained.isEmpty():
        return state, links, None
    inside = chained.select("trace_id", F.col("unit").alias("start"), F.lit(True).alias("more"))
    entry = alive.withColumnsRenamed({"dst": "unit", "src": "start"}).join(chained.select("trace_id", "unit", "duration_ns", "best"), ["trace_id", "unit"])
    floor, gain = F.greatest("best", "floor") + F.col("duration_ns"), F.col("gain") + F.col("duration_ns")
    walk = entry.select("trace_id", "unit", "start", floor.alias("floor"), gain.alias("gain")).join(inside, ["trace_id", "start"], "left")
    walk = materialize(walk.select("trace_id", "unit", "start", "floor", "gain", F.coalesce("more", F.lit(False)).alias("more")), "chains")
    longest = walk.groupBy("trace_id").count().agg(F.max("count")).first()[0]
    for _ in range(longest.bit_length() // 2 + 1):
        if walk.where("more").isEmpty():
            break
        walk = materialize(_jumped(_jumped(walk)), "chains")
    removed = walk.where("NOT more").drop("more")
    ends = lambda side: chained.select("trace_id", F.col("unit").alias(side))
    outward = alive.join(ends("dst"), ["trace_id", "dst"], "left_anti")
    plain = outward.join(ends("src"), ["trace_id", "src"], "left_anti")
    last = removed.select("trace_id", F.col("unit").alias("src"), "start", F.col("floor").alias("floor2"), F.col("gain").alias("gain2"))
    short = outward.join(last, ["trace_id", "src"]).select(
        "trace_id", F.col("start").alias("src"), "dst", (F.col("gain") + F.col("gain2")).alias("gain"), F.greatest("floor", F.col("floor2") + F.col("gain")).alias("floor")
    )
    links = plain.unionByName(short, allowMissingColumns=True).groupBy("trace_id", "src", "dst").agg(F.max("gain").alias("gain"), F.max("floor").alias("floor"))
    links = materialize(links, "links")
    degree = links.groupBy("trace_id", F.col("dst").alias("unit")).agg(F.count("*").alias("now"))
    state = state.join(chained.select("trace_id", "unit"), ["trace_id", "unit"], "left_anti").join(degree, ["trace_id", "unit"], "left")
    state = state.select("trace_id", "unit", "duration_ns", F.coalesce("now", F.lit(0).cast("bigint")).alias("open"), "best")
    return materialize(state, "open"), links, removed


def _jumped(walk: DataFrame) -> DataFrame:
    """Pointers twice as far as before."""
    ahead = walk.select("trace_id", F.col("unit").alias("start"), F.col("start").alias("start2"), F.col("floor").alias("floor2"), F.col("gain").alias("gain2"), F.col("more").alias("more2"))
    far = walk.where("more").join(ahead, ["trace_id", "start"]).select(
        "trace_id", "unit", F.col("start2").alias("start"), F.greatest("floor", F.col("floor2") + F.col("gain")).alias("floor"), (F.col("gain") + F.col("gain2")).alias("gain"), F.col("more2").alias("more")
    )
    return walk.where("NOT more").unionByName(far)


def cycle_units(residue: DataFrame, edges: DataFrame) -> DataFrame:
    """(trace_id, unit) of the units on a cycle, of those on or behind one; bridges between cycles are on none.

    Strongly connected components of all graphs at once.  A round first contracts chains,
    whose units are on a cycle if both ends are in one component.  Then every unit takes
    the largest unit that reaches it as its colour; what reaches that unit back within the
    colour is its component and goes, with all links between colours.
    """
    inside = lambda c: residue.select("trace_id", F.col("unit").alias(c))
    links = edges.where("src <> dst").join(inside("src"), ["trace_id", "src"], "left_semi").join(inside("dst"), ["trace_id", "dst"], "left_semi")
    links = materialize(links.select("trace_id", "src", "dst"), "looped")
    found, chains = [residue.where("false").select("trace_id", "unit", F.col("unit").alias("component"))], []
    while not links.isEmpty():
        links, inner, rings = _short_links(links)
        if inner is not None:
            chains.append(inner)
            found.append(rings.select("trace_id", "unit", F.col("unit").alias("component")))
        loops = links.where("src = dst").select("trace_id", F.col("src").alias("unit"), F.col("src").alias("component"))
        found.append(materialize(loops, "loops"))
        links = materialize(_trimmed(links.where("src <> dst")), "looped")
        if links.isEmpty():
            break
        colours = _colours(links)
        own = lambda c: colours.select("trace_id", F.col("unit").alias(c), F.col("colour").alias(f"{c}_colour"))
        same = links.join(own("src"), ["trace_id", "src"]).join(own("dst"), ["trace_id", "dst"]).where("src_colour = dst_colour")
        same = materialize(same.select("trace_id", "src", "dst", F.col("src_colour").alias("colour")), "same")
        back = _reaching(colours, same)
        large = back.groupBy("trace_id", "component").count().where("count > 1").select("trace_id", "component")
        found.append(materialize(back.join(large, ["trace_id", "component"], "left_semi"), "components"))
        gone = lambda c: back.select("trace_id", F.col("unit").alias(c))
        links = materialize(same.join(gone("src"), ["trace_id", "src"], "left_anti").join(gone("dst"), ["trace_id", "dst"], "left_anti").select("trace_id", "src", "dst"), "looped")
    # a unit may be a loop of one round and in a component of another: they are one, by the largest name
    every = materialize(reduce(DataFrame.unionByName, found).groupBy("trace_id", "unit").agg(F.max("component").alias("component")), "components")
    for inner in reversed(chains):
        one = lambda c: every.select("trace_id", F.col("unit").alias(c), F.col("component").alias(f"{c}_in"))
        own = inner.join(one("start"), ["trace_id", "start"]).join(one("stop"), ["trace_id", "stop"]).where("start_in = stop_in")
        every = materialize(every.unionByName(own.select("trace_id", "unit", F.col("start_in").alias("component"))), "components")
    return every.select("trace_id", "unit").distinct()


def _trimmed(links: DataFrame, turns: int = 2) -> DataFrame:
    """Links without those that begin where nothing arrives or end where nothing leaves."""
    for _ in range(turns):
        ends = lambda c, other, now=links: now.select("trace_id", F.col(c).alias(other)).distinct()
        links = materialize(links.join(ends("dst", "src"), ["trace_id", "src"], "left_semi").join(ends("src", "dst"), ["trace_id", "dst"], "left_semi"), "trimmed")
    return links


def _short_links(links: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Links with chains contracted, the units of chains with the units at both ends, and those on rings alone."""
    nodes = links.select("trace_id", F.col("src").alias("unit")).unionByName(links.select("trace_id", F.col("dst").alias("unit"))).distinct()
    alive, chained = _chained(materialize(nodes, "nodes"), links)
    if chained.isEmpty():
        return links, None, None
    ends = alive.withColumnsRenamed({"dst": "unit", "src": "start"}).join(alive.withColumnsRenamed({"src": "unit", "dst": "stop"}), ["trace_id", "unit"])
    walk = ends.join(chained, ["trace_id", "unit"], "left_semi")
    for side in ("start", "stop"):
        inside = chained.select("trace_id", F.col("unit").alias(side), F.lit(True).alias(f"more_{side}"))
        walk = walk.join(inside, ["trace_id", side], "left").withColumn(f"more_{side}", F.coalesce(f"more_{side}", F.lit(False)))
    names = ["trace_id", "unit", "start", "stop", "more_start", "more_stop"]
    walk = materialize(walk.select(names), "chains")
    longest = walk.groupBy("trace_id").count().agg(F.max("count")).first()[0]
    for _ in range(longest.bit_length()):
        if walk.where("more_start OR more_stop").isEmpty():
            break
        for side in ("start", "stop"):
            ahead = walk.select("trace_id", F.col("unit").alias(side), F.col(side).alias("next"), F.col(f"more_{side}").alias("again"), F.lit(True).alias("met"))
            jump = lambda new, old: F.when(F.col(f"more_{side}"), F.col(new)).otherwise(F.col(old)).alias(old)  # noqa: E731, B023
            other = [x for x in names if x not in (side, f"more_{side}")]
            step = walk.join(ahead, ["trace_id", side], "left").select(*other, jump("next", side), jump("again", f"more_{side}"))
            # both sides jump by the pointers of the same round
            moved = step if side == "start" else moved.drop("stop", "more_stop").join(step.select("trace_id", "unit", "stop", "more_stop"), ["trace_id", "unit"])  # noqa: F821
        walk = materialize(moved.select(names), "chains")
    inner = walk.where("NOT more_start AND NOT more_stop").select("trace_id", "unit", "start", "stop")
    out = lambda side: chained.select("trace_id", F.col("unit").alias(side))
    plain = alive.join(out("src"), ["trace_id", "src"], "left_anti").join(out("dst"), ["trace_id", "dst"], "left_anti")
    short = plain.unionByName(inner.select("trace_id", F.col("start").alias("src"), F.col("stop").alias("dst"))).distinct()
    return materialize(short, "looped"), inner, walk.where("more_start OR more_stop").select("trace_id", "unit")


def _colours(links: DataFrame) -> DataFrame:
    """(trace_id, unit, colour): the largest unit that reaches each unit, itself included."""
    nodes = links.select("trace_id", F.col("src").alias("unit")).unionByName(links.select("trace_id", F.col("dst").alias("unit"))).distinct()
    state = materialize(nodes.select("trace_id", "unit", F.col("unit").alias("colour"), F.lit(True).alias("fresh")), "colours")
    while not state.where("fresh").isEmpty():
        sent = links.join(state.where("fresh").select("trace_id", F.col("unit").alias("src"), "colour"), ["trace_id", "src"])
        sent = sent.groupBy("trace_id", F.col("dst").alias("unit")).agg(F.max("colour").alias("got"))
        new = state.join(sent, ["trace_id", "unit"], "left").select("trace_id", "unit", F.greatest("colour", "got").alias("colour"), F.coalesce(F.col("got") > F.col("colour"), F.lit(False)).alias("fresh"))
        state = materialize(new, "colours")
    return state.drop("fresh")


def _reaching(colours: DataFrame, same: DataFrame) -> DataFrame:
    """(trace_id, unit, component): what reaches the unit that gave it its colour over links of that colour."""
    held = fresh = materialize(colours.where("unit = colour").select("trace_id", "unit", F.col("colour").alias("component")), "reaching")
    while not fresh.isEmpty():
        near = same.join(fresh.select("trace_id", F.col("unit").alias("dst")), ["trace_id", "dst"]).select("trace_id", F.col("src").alias("unit"), F.col("colour").alias("component")).distinct()
        fresh = materialize(near.join(held.select("trace_id", "unit"), ["trace_id", "unit"], "left_anti"), "reaching")
        held = held.unionByName(fresh)
    return held


def walked_back(ends: DataFrame, known: DataFrame) -> DataFrame:
    """(trace_id, unit, back): every unit on the path of predecessors from `ends` (trace_id, unit), and how far back.

    Rounds double what is covered: after k of them, all units fewer than 2**k steps back.
    """
    jump = known.where("pred IS NOT NULL").select("trace_id", "unit", F.col("pred").alias("up"))
    walked, step = materialize(ends.select("trace_id", "unit", F.lit(0).alias("back")), "path"), 1
    while True:
        more = materialize(walked.join(jump, ["trace_id", "unit"]).select("trace_id", F.col("up").alias("unit"), (F.col("back") + step).alias("back")), "step")
        if more.isEmpty():
            return walked
        walked, step = materialize(walked.unionByName(more), "path"), 2 * step
        above = jump.select("trace_id", F.col("unit").alias("up"), F.col("up").alias("up2"))
        farther = materialize(jump.join(above, ["trace_id", "up"]).select("trace_id", "unit", F.col("up2").alias("up")), "jumps")
        discard(jump, more)
        jump = farther


#: most spans of a trace that one task solves at once; larger graphs take rounds of joins
SMALL = 10_000
_SOLVED = "trace_id string, span_id string, unit int, duration_ns long, faults array<string>, owner boolean, solved boolean, finish long, pred int, looped boolean, edge_count int, missing array<int>, back int"


def _parsed(spans: DataFrame) -> DataFrame:
    """Spans with their unit, its targets and the codes of what is wrong in their text."""
    good, bad = S.parse_unblocks(F.col("unblocks_text"))
    unit = S.parse_unit(F.col("unit_text"))
    rows = spans.select("trace_id", "span_id", "ord", "duration_ns", unit.alias("unit"), good.alias("targets"), F.size(bad).alias("bad"), "unit_text", "unblocks_text")
    faults = F.array(
        F.when(F.col("unit_text").isNotNull() & F.col("unit").isNull(), "invalid_unit"), F.when(F.col("unit").isNull() & F.col("unblocks_text").isNotNull(), "unblocks_without_unit"),
        F.when(F.col("unit").isNotNull() & (F.col("bad") > 0), "invalid_unblocks"),
    )
    return rows.select("trace_id", "span_id", "ord", "duration_ns", "unit", "targets", F.array_compact(faults).alias("faults"))


def _solved(rows: DataFrame, order: Column, lenient: bool = False) -> DataFrame:
    """Rows of `_parsed` with what their unit has in its graph, as a table placed by trace.

    The first row of a unit by `order` owns it.  Graphs of up to SMALL spans are solved
    where they lie; rows of larger ones, of traces without a name and of sums that might
    not fit come back as they are, not `solved`.
    """
    placed = rows.repartition("trace_id").sortWithinPartitions("trace_id", "unit", order)
    placed = placed.select("trace_id", "span_id", "unit", "duration_ns", "faults", "targets")
    most = SMALL
    return bucketed(placed.mapInArrow(lambda batches: small_graphs.solved(batches, most, lenient), _SOLVED), "solved")


def critical_path(spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports, path spans and issues of every trace.

    Status is malformed, cyclic, missing, no_edge (no units) or ok, in this order of
    precedence; `critical_ns` is null and there is no path unless it is ok.  Among end
    units of equal finish the smallest counts.
    """
    columns = ["trace_id", "span_id", "ord", "duration_ns", "unit_text", "unblocks_text"]
    found = _solved(_parsed(spans), F.col("ord"))
    report, path, issues = _reported(found.where("solved"))
    large = found.where("NOT solved").select("trace_id").distinct()
    if not large.isEmpty():
        keyed = materialize(large, "large").select(F.struct("trace_id").alias("_key"))  # in a struct, nulls are equal
        more = _critical_path_by_joins(spans.select(*columns).withColumn("_key", F.struct("trace_id")).join(keyed, "_key", "left_semi").drop("_key"))
        report, path, issues = (one.unionByName(other) for one, other in zip((report, path, issues), more))
    return report, path, issues


def _reported(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`critical_path` of rows that `_solved` has solved; all are placed by trace, so nothing is shuffled."""
    none = F.lit(None).cast("int")
    issue = lambda code, unit: F.struct(F.lit(code).alias("code"), unit.alias("unit"))
    unit, valid = F.col("unit"), F.col("unit").isNotNull()
    # what a duplicate unit unblocks counts for nothing, whatever it is
    of_text = F.transform(F.filter("faults", lambda c: (c != "invalid_unblocks") | F.col("owner")), lambda c: F.struct(c.alias("code"), F.when(c == "invalid_unblocks", unit).otherwise(none).alias("unit")))
    of_graph = F.array_compact(F.array(F.when(valid & ~F.col("owner"), issue("duplicate_unit", unit)), F.when(F.col("looped"), issue("cycle", unit))))
    every = F.concat(of_text, of_graph, F.transform("missing", lambda x: issue("missing_unit", x)))
    codes = F.concat(F.transform(of_text, lambda x: x["code"]), F.transform(of_graph, lambda x: x["code"]), F.transform("missing", lambda x: F.lit("missing_unit")))
    issues = found.select("trace_id", "span_id", F.explode(every).alias("i")).select("trace_id", "i.code", "span_id", "i.unit").distinct()
    owned = lambda c: F.when(F.col("owner"), F.col(c))
    rows = found.withColumn("codes", codes)
    has = lambda *names: F.max(F.arrays_overlap("codes", F.array(*map(F.lit, names))))
    report = rows.groupBy("trace_id").agg(
        has("duplicate_unit", "invalid_unit", "invalid_unblocks", "unblocks_without_unit").alias("malformed"), has("cycle").alias("cyclic"), has("missing_unit").alias("missing"),
        F.sum(owned("duration_ns")).alias("total_work_ns"), F.count_if("owner").alias("unit_count"), F.sum("edge_count").alias("edge_count"), F.max(F.when(F.col("back") == 0, F.col("finish"))).alias("top"), F.count("back").alias("n"),
    )
    status = F.when(F.col("malformed"), "malformed").when(F.col("cyclic"), "cyclic").when(F.col("missing"), "missing").when(F.col("unit_count") == 0, "no_edge").otherwise("ok")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    report = report.withColumn("status", status).withColumn("path_count", F.when(F.col("status") == "ok", F.col("n")).otherwise(F.lit(0)))
    report = report.select("trace_id", "status", F.when(F.col("status") == "ok", F.col("top")).alias("critical_ns"), zero("total_work_ns"), zero("unit_count"), zero("edge_count"), "path_count")
    steps = report.where("status = 'ok'").select("trace_id", F.col("path_count").alias("steps"))
    path = found.where("back IS NOT NULL").join(steps, "trace_id").withColumn("position", (F.col("steps") - 1 - F.col("back")).cast("int"))
    return report, path.select("trace_id", "position", "unit", "span_id", "duration_ns", F.col("finish").alias("finish_ns")), issues


def _critical_path_by_joins(spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`critical_path` of graphs of any size, by rounds of joins."""
    units, edges, issues = build_graph(spans)
    known, residue = finish_times(units, edges)
    looped = cycle_units(residue, edges)
    issues = issues.unionByName(looped.join(units, ["trace_id", "unit"]).select("trace_id", F.lit("cycle").alias("code"), "span_id", "unit")).distinct()
    issues = materialize(issues, "issues")
    flags = issues.groupBy("trace_id").agg(
        F.max(F.col("code").isin("duplicate_unit", "invalid_unit", "invalid_unblocks", "unblocks_without_unit")).alias("malformed"), F.max(F.col("code") == "cycle").alias("cyclic"), F.max(F.col("code") == "missing_unit").alias("missing")
    )
    work = units.groupBy("trace_id").agg(F.sum("duration_ns").alias("total_work_ns"), F.count("*").alias("unit_count"))
    links = edges.groupBy("trace_id").agg(F.count("*").alias("edge_count"))
    ends = known.groupBy("trace_id").agg(F.max(F.struct("finish", (-F.col("unit")).alias("neg"))).alias("end"))
    report = spans.select("trace_id").distinct().join(flags, "trace_id", "left").join(work, "trace_id", "left").join(links, "trace_id", "left").join(ends, "trace_id", "left")
    status = F.when(F.col("malformed"), "malformed").when(F.col("cyclic"), "cyclic").when(F.col("missing"), "missing").when(F.col("unit_count").isNull(), "no_edge").otherwise("ok")
    report = report.withColumn("status", status).withColumn("critical_ns", F.when(status == "ok", F.col("end.finish")))
    report = materialize(report.withColumn("end_unit", F.when(status == "ok", -F.col("end.neg"))), "report")
    known = materialize(known, "finish")
    ends = report.where("end_unit IS NOT NULL").select("trace_id", F.col("end_unit").cast("int").alias("unit"))
    path = walked_back(ends, known).join(known.select("trace_id", "unit", "finish"), ["trace_id", "unit"]).join(units, ["trace_id", "unit"])
    position = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("back"))) - 1
    path = path.withColumn("position", position).select("trace_id", "position", "unit", "span_id", "duration_ns", F.col("finish").alias("finish_ns"))
    count = F.coalesce("path_count", F.lit(0)).alias("path_count")
    sizes = path.groupBy("trace_id").agg(F.count("*").alias("path_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    report = report.join(sizes, "trace_id", "left").select("trace_id", "status", "critical_ns", zero("total_work_ns"), zero("unit_count"), zero("edge_count"), count)
    return report, path, issues


def critical_path_lenient(spans: DataFrame) -> DataFrame:
    """(trace_id, critical_ns) over what is left when bad tokens, self edges, absent targets and cycles are dropped; the last span of a unit owns it."""
    good, _ = S.parse_unblocks(F.col("unblocks_text"))
    rows = spans.select("trace_id", "span_id", "ord", "duration_ns", F.col("unit_text").try_cast("int").alias("unit"), good.alias("targets"), F.array().cast("array<string>").alias("faults")).where("unit IS NOT NULL")
    found = _solved(rows, F.desc("ord"), lenient=True)
    lengths = found.where("solved").groupBy("trace_id").agg(F.max("finish").alias("critical_ns"))
    large = found.where("NOT solved").select("trace_id").distinct()
    if large.isEmpty():
        return lengths
    keyed = materialize(large, "large").select(F.struct("trace_id").alias("_key"))
    return lengths.unionByName(_lenient_by_joins(spans.withColumn("_key", F.struct("trace_id")).join(keyed, "_key", "left_semi").drop("_key")))


def _lenient_by_joins(spans: DataFrame) -> DataFrame:
    """`critical_path_lenient` of graphs of any size, by rounds of joins."""
    rows = spans.withColumn("unit", F.col("unit_text").try_cast("int")).where("unit IS NOT NULL")
    last = F.row_number().over(Window.partitionBy("trace_id", "unit").orderBy(F.desc("ord")))
    rows = materialize(rows.withColumn("_turn", last).where("_turn = 1").drop("_turn"), "lenient")
    good, _ = S.parse_unblocks(F.col("unblocks_text"))
    units = rows.select("trace_id", "unit", "span_id", "duration_ns")
    edges = rows.select("trace_id", F.col("unit").alias("src"), F.explode(good).alias("dst")).where("src <> dst")
    edges = edges.join(units.select("trace_id", F.col("unit").alias("dst")), ["trace_id", "dst"], "left_semi").distinct()
    known, residue = finish_times(units, edges)
    residue = materialize(residue, "residue")
    inside = lambda c: residue.select("trace_id", F.col("unit").alias(c))
    looped = edges.join(inside("src"), ["trace_id", "src"], "left_semi").join(inside("dst"), ["trace_id", "dst"], "left_semi")
    if not residue.isEmpty():
        known, _ = finish_times(units, edges.join(looped, ["trace_id", "src", "dst"], "left_anti"))
    return known.groupBy("trace_id").agg(F.max("finish").alias("critical_ns"))


def validate(report: DataFrame, path: DataFrame) -> DataFrame:
    """Broken invariants of critical-path reports; no row if all hold."""
    sums = path.groupBy("trace_id").agg(F.sum("duration_ns").alias("path_ns"), F.count("*").alias("n"))
    rows = report.join(sums, "trace_id", "left")
    rules = {
        "path_without_ok": "status <> 'ok' AND (critical_ns IS NOT NULL OR n IS NOT NULL)",
        "path_sum": "status = 'ok' AND coalesce(path_ns, -1) <> critical_ns",
        "path_count": "coalesce(n, 0) <> path_count",
        "work_below_path": "critical_ns > total_work_ns",
    }
    found = F.array_compact(F.array(*(F.when(F.expr(rule), name) for name, rule in rules.items())))
    return rows.select("trace_id", F.explode(found).alias("violation"))
