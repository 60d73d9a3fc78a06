"""Rows of a waterfall: gaps between children, rolled-up long tails, bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import scalars as S
from spanloom.operators.tree import assemble_tree, preorder
from spanloom.sources.shared import bucketed

WIDTH = 60
MAX_ROWS = 20
#: fixed text of the trace format's render-only rows
GAP_NAME = "(gap)"


def without_sections(spans: DataFrame, key: str = "cargo.section") -> DataFrame:
    """Spans without the attribute that marks sub-sections."""
    return spans.where(~S.has_attr(F.col("attributes"), key))


def _roots(tree: DataFrame) -> DataFrame:
    return tree.where("depth = 0").select("trace_id", F.col("started_ns").alias("root_started_ns"), F.col("ended_ns").alias("root_ended_ns"))


def gaps(tree: DataFrame, width: int = WIDTH) -> DataFrame:
    """Uncovered stretches of every parent that has children, one row each.

    The cursor runs over the children by start and keeps the latest end so far; a child
    that starts behind it, and the parent's own end, leave a gap if it is wide enough.
    """
    parents = tree.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("started_ns").alias("p_start"), F.col("ended_ns").alias("p_end"), F.col("depth").alias("p_depth"))
    roots = _roots(tree).select("trace_id", S.gap_min_ns(F.col("root_ended_ns") - F.col("root_started_ns"), width).alias("min_ns"))
    kids = tree.where("depth > 0").join(parents, ["trace_id", "parent_span_id"]).join(roots, "trace_id").where("min_ns > 0")
    by_start = Window.partitionBy("trace_id", "parent_span_id").orderBy("started_ns", "ord")
    before = F.max("ended_ns").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    kids = kids.withColumn("from_ns", F.greatest("p_start", F.coalesce(before, "p_start")))
    common = ["trace_id", "parent_span_id", "p_depth", "min_ns"]
    inner = kids.where("started_ns > from_ns").select(*common, "from_ns", F.col("started_ns").alias("to_ns"))
    last = kids.groupBy("trace_id", "parent_span_id").agg(*(F.first(c).alias(c) for c in common[2:]), F.first("p_end").alias("to_ns"), F.greatest(F.max("ended_ns"), F.first("p_start")).alias("from_ns"))
    found = inner.unionByName(last.select(*common, "from_ns", "to_ns")).where("to_ns - from_ns >= min_ns")
    index = F.row_number().over(Window.partitionBy("trace_id", "parent_span_id").orderBy("from_ns")) - 1
    return found.withColumn("gap_index", index).select(
        "trace_id", F.concat(F.lit("gap:"), "parent_span_id", F.lit(":"), F.col("gap_index").cast("string")).alias("span_id"), "parent_span_id", F.lit(GAP_NAME).alias("name"),
        F.lit(1).alias("kind"), F.lit(1).alias("status"), F.col("from_ns").alias("started_ns"), F.col("to_ns").alias("ended_ns"), (F.col("to_ns") - F.col("from_ns")).alias("duration_ns"),
        (F.col("p_depth") + 1).cast("int").alias("depth"),
    )


def ranked(tree: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Add `rank` (longest first among real siblings) and `collapsed`."""
    siblings = Window.partitionBy("trace_id", "parent_span_id")
    rank = F.row_number().over(siblings.orderBy(F.desc("duration_ns"), "started_ns", "ord"))
    over = F.count("*").over(siblings) > max_rows
    out = tree.withColumn("rank", rank)
    return out.withColumn("collapsed", F.when(F.col("parent_span_id").isNotNull(), over & (F.col("rank") >= max_rows)).otherwise(F.lit(False)))


def rollup_buckets(tree: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row for the collapsed children of every parent that has too many."""
    tail = ranked(tree, max_rows).where("collapsed")
    found = tail.groupBy("trace_id", "parent_span_id").agg(
        F.min("started_ns").alias("started_ns"), F.max("ended_ns").alias("ended_ns"), F.sum("duration_ns").alias("duration_ns"),
        F.when(F.max(F.col("status") == 2), F.lit(2)).otherwise(F.lit(1)).alias("status"), F.count("*").alias("n"), F.first("depth").alias("depth"),
    )
    return found.select(
        "trace_id", F.concat(F.lit("rollup:"), "parent_span_id").alias("span_id"), "parent_span_id", F.concat(F.lit("(+"), F.col("n").cast("string"), F.lit(" more)")).alias("name"),
        F.lit(1).alias("kind"), "status", "started_ns", "ended_ns", "duration_ns", "depth",
    )


def waterfall(spans: DataFrame, width: int = WIDTH, max_rows: int = MAX_ROWS, with_gaps: bool = True) -> DataFrame:
    """The visible rows of every trace with their bars, in order of `position`.

    A span is visible if neither it nor one of its ancestors is collapsed; gaps and
    buckets show under visible parents.  `bar_duration_ns` is what the bar spans,
    `work_ns` the row's own duration, which for a bucket is the sum of its spans.
    """
    columns = ["trace_id", "span_id", "parent_span_id", "name", "kind", "status", "started_ns", "ended_ns", "duration_ns", "ord"]
    tree = assemble_tree(spans.select(*columns), False, (lambda one: ranked(one, max_rows)) if max_rows > 0 else (lambda one: one.withColumn("collapsed", F.lit(False))))
    hidden = tree.where("under").select("trace_id", F.col("span_id").alias("parent_span_id"))
    # siblings in order of start: spans first on ties, then gaps, then the bucket
    entry = lambda rows, rank, node, turn: rows.select(*columns[:-1], "depth", F.lit(rank).alias("rank"), node.alias("node"), turn.cast("bigint").alias("ord"))
    rows = entry(tree.where("NOT under"), 1, F.col("span_id"), F.col("ord"))
    nobody = F.lit(None).cast("string")
    seen = lambda found: found.join(hidden, ["trace_id", "parent_span_id"], "left_anti")
    if with_gaps:
        rows = rows.unionByName(entry(seen(gaps(tree, width)), 2, nobody, F.lit(0)))
    if max_rows > 0:
        rows = rows.unionByName(entry(seen(rollup_buckets(tree.drop("rank", "collapsed"), max_rows)), 3, nobody, F.lit(0)))
    rows = bucketed(rows.repartition("trace_id"), "rows")
    rows = preorder(rows, order=("started_ns", "rank", "ord"), id_col="node").join(_roots(tree), "trace_id")
    offset, wide = S.bar_geometry(F.col("started_ns"), F.col("ended_ns"), F.col("root_started_ns"), F.col("root_ended_ns"), width)
    rows = rows.withColumn("offset", offset).withColumn("width", wide)
    return rows.select("trace_id", "position", "span_id", "name", "depth", "status", "offset", "width", (F.col("ended_ns") - F.col("started_ns")).alias("bar_duration_ns"), F.col("duration_ns").alias("work_ns"))


def diff_traces(spans: DataFrame, pairs: DataFrame, by_impact: bool = False) -> DataFrame:
    """Compare the traces of every pair (a, b) by (name, depth, n-th occurrence).

    `kind` is matched, added (only in b) or removed (only in a); `position` is a's
    pre-order, then what only b has in its own; with `by_impact` the largest change first.
    """
    tree = assemble_tree(spans.select("trace_id", "span_id", "parent_span_id", "name", "started_ns", "duration_ns", "ord"), chains=False)
    tree = preorder(tree)
    nth = F.row_number().over(Window.partitionBy("trace_id", "name", "depth").orderBy("position")) - 1
    keyed = bucketed(tree.withColumn("occurrence", nth).select("trace_id", "name", "depth", "occurrence", "position", "duration_ns"), "keyed")
    value = lambda s, own, c: F.col(c) if s == own else F.lit(None).cast("bigint")
    nameless = F.col("name").isNull()  # spans without a name match nothing

    def side(own: str) -> DataFrame:
        found = pairs.join(keyed, pairs[own] == keyed.trace_id)
        return found.select("a", "b", "name", "depth", "occurrence", F.when(nameless, own).alias("alone"), *(value(s, own, c).alias(f"{s}_{n}") for s in "ab" for c, n in (("position", "pos"), ("duration_ns", "ns"))))

    # both sides are shuffled by pair, once, and matched and put in order there
    both = side("a").unionByName(side("b")).repartition("a", "b").groupBy("a", "b", "name", "depth", "occurrence", "alone")
    both = both.agg(*(F.max(f"{s}_{n}").alias(f"{s}_{n}") for s in "ab" for n in ("pos", "ns")))
    kind = F.when(F.col("a_pos").isNull(), "added").when(F.col("b_pos").isNull(), "removed").otherwise("matched")
    delta = F.when(F.col("a_pos").isNotNull() & F.col("b_pos").isNotNull(), F.col("b_ns") - F.col("a_ns"))
    impact = F.coalesce(F.abs(delta), "a_ns", "b_ns")
    both = both.withColumn("kind", kind).withColumn("delta_ns", delta).withColumn("impact_ns", impact)
    structural = [F.col("a_pos").isNull(), F.coalesce("a_pos", "b_pos")]
    order = [F.desc("impact_ns"), *structural] if by_impact else structural
    position = F.row_number().over(Window.partitionBy("a", "b").orderBy(*order)) - 1
    return both.withColumn("position", position).select("a", "b", "position", "kind", "name", "depth", "occurrence", "a_ns", "b_ns", "delta_ns", "impact_ns")


def trace_summaries(spans: DataFrame) -> DataFrame:
    """Bounds, number of spans and root name of every trace.

    The root is the first parentless span, else the first; an end before the epoch counts as 0.
    """
    first = F.struct(F.col("parent_span_id").isNotNull(), "ord")
    found = spans.groupBy("trace_id").agg(F.min("started_ns").alias("started_ns"), F.greatest(F.lit(0), F.max("ended_ns")).alias("ended_ns"), F.min_by("name", first).alias("root_name"), F.count("*").alias("span_count"))
    return found.withColumn("duration_ns", F.col("ended_ns") - F.col("started_ns"))


def recent_traces(summaries: DataFrame, n: int = 50) -> DataFrame:
    """The newest traces first; none for n below 1."""
    return summaries.orderBy(F.desc("started_ns"), "trace_id").limit(max(0, n))


def span_detail(spans: DataFrame) -> DataFrame:
    """Every span as an inspector shows it: labels, times as text, and its attributes as lines."""
    line = lambda a: F.concat(F.rpad(a["key"], F.greatest(F.char_length(a["key"]), F.lit(24)), F.lit(" ")), F.lit(" ("), a["value_type"], F.lit(") "), a["value"])
    lines = F.when(F.coalesce(F.size("attributes"), F.lit(0)) <= 0, F.array(F.lit("(none)"))).otherwise(F.transform("attributes", line))
    return spans.select(
        "trace_id", "name", "span_id", F.coalesce("parent_span_id", F.lit("(root)")).alias("parent"), S.kind_label(F.col("kind")).alias("kind"), S.status_label(F.col("status")).alias("status"),
        S.format_duration(F.col("duration_ns")).alias("duration"), S.format_timestamp(F.col("started_ns")).alias("started"), S.format_timestamp(F.col("ended_ns")).alias("ended"), lines.alias("attributes"),
    )


def issue_codes(issues: DataFrame) -> DataFrame:
    """The sorted distinct codes of every trace."""
    return issues.groupBy("trace_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def ordered_issues(issues: DataFrame, order: tuple[str, ...] = ("code", "span_id", "attribute")) -> DataFrame:
    """Issues with their `position` in their trace's report; ledgers order by code first, chains by span."""
    by = [F.coalesce(F.col(c), F.lit("")) for c in order]
    return issues.withColumn("position", F.row_number().over(Window.partitionBy("trace_id").orderBy(*by)) - 1)
