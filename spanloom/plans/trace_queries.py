"""Registered queries over the span, mark, suite and build projections, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import scalars as S
from spanloom.operators import critical, graft, marks, timeline, tree
from spanloom.plans.projections import sql, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WIDTH, ROWS = 60, 8


def register(name: str, oracle: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query

    return keep


_TREE = sql("td_kept").replace("WITH ", "WITH RECURSIVE ", 1) + """, tree AS (
  SELECT trace_id, span_id, parent_span_id, name, kind, status, started_ns, ended_ns, duration_ns, ord, 0 AS depth, [[started_ns, ord]] AS path, [span_id] AS chain
  FROM td_kept WHERE parent_span_id IS NULL
  UNION ALL
  SELECT s.trace_id, s.span_id, s.parent_span_id, s.name, s.kind, s.status, s.started_ns, s.ended_ns, s.duration_ns, s.ord, t.depth + 1,
         list_append(t.path, [s.started_ns, s.ord]), list_append(t.chain, s.span_id)
  FROM td_kept s JOIN tree t ON t.trace_id = s.trace_id AND t.span_id = s.parent_span_id)"""  # fmt: skip


@register("D1_trace_summary", f"""{sql("td_spans")} SELECT trace_id, min(started_ns) AS started_ns, greatest(0, max(ended_ns)) AS ended_ns,
  arg_min(name, (CASE WHEN parent_span_id IS NULL THEN 0 ELSE 1 END) * 1000000 + ord) AS root_name, count(*) AS span_count,
  greatest(0, max(ended_ns)) - min(started_ns) AS duration_ns FROM td_spans GROUP BY trace_id""")
def trace_summary(spark, sf_dir):
    return timeline.trace_summaries(view(spark, sf_dir, "td_spans"))


_SUMMARY = f"({ORACLES['D1_trace_summary']})"


@register("H1_recent_traces", f"SELECT trace_id, started_ns, span_count FROM {_SUMMARY} ORDER BY started_ns DESC, trace_id LIMIT 50")
def recent(spark, sf_dir):
    return timeline.recent_traces(trace_summary(spark, sf_dir)).select("trace_id", "started_ns", "span_count")


_DURATION = """CASE WHEN {0} >= 1000000000 THEN printf('%.2fs', {0}::DOUBLE / 1000000000) WHEN {0} >= 1000000 THEN ({0} // 1000000) || 'ms'
  WHEN {0} >= 1000 THEN ({0} // 1000) || 'µs' ELSE {0} || 'ns' END"""
_NOW = 915_148_800_000_000_000


@register("M7_list_traces", f"""SELECT substr(trace_id, 1, 8) AS short_id, root_name AS label, {_DURATION.format('duration_ns')} AS duration,
  CASE WHEN a < 60 THEN a || 's ago' WHEN a < 3600 THEN (a // 60) || 'm ago' WHEN a < 86400 THEN (a // 3600) || 'h ago' ELSE (a // 86400) || 'd ago' END AS age
  FROM (SELECT *, greatest(0, {_NOW} - started_ns) // 1000000000 AS a FROM {_SUMMARY} ORDER BY started_ns DESC, trace_id LIMIT 50)""")
def list_traces(spark, sf_dir):
    rows = timeline.recent_traces(trace_summary(spark, sf_dir))
    return rows.select(S.short_trace_id(F.col("trace_id")).alias("short_id"), S.clean_label(F.col("root_name"), 40).alias("label"), S.format_duration(F.col("duration_ns")).alias("duration"), S.human_age(F.col("started_ns"), F.lit(_NOW)).alias("age"))


@register("B_scalars", f"""{sql("td_spans")} SELECT trace_id, span_id,
  (['unspecified', 'internal', 'server', 'client', 'producer', 'consumer'])[kind + 1] AS kind_label, (['unset', 'ok', 'error'])[status + 1] AS status_label,
  {_DURATION.format("(duration_ns // 7777)")} AS short_duration, strftime(make_timestamp(started_ns // 1000), '%Y-%m-%d %H:%M:%S.%g') || ' UTC' AS started,
  CASE WHEN length(name) <= 6 THEN name ELSE left(name, 5) || '…' END AS label, 'sha256:v1:' || sha256('spanloom:redaction:v1' || chr(0) || name) AS digest,
  CASE WHEN d > 0 THEN '+' || {_DURATION.format("d")} WHEN d < 0 THEN '-' || {_DURATION.format("(-d)")} ELSE '0' END AS signed_duration
  FROM (SELECT *, duration_ns // 1000 - 43200000000 AS d FROM td_spans) q""")
def scalars(spark, sf_dir):
    c = F.col
    return view(spark, sf_dir, "td_spans").select(
        "trace_id", "span_id", S.kind_label(c("kind")).alias("kind_label"), S.status_label(c("status")).alias("status_label"), S.format_duration(S.idiv(c("duration_ns"), 7777)).alias("short_duration"),
        S.format_timestamp(c("started_ns")).alias("started"), S.clean_label(c("name"), 6).alias("label"), S.stable_digest(c("name")).alias("digest"), S.signed_duration(S.idiv(c("duration_ns"), 1000) - 43_200_000_000).alias("signed_duration"),
    )


@register("G1_assemble_tree", f"{_TREE} SELECT trace_id, span_id, depth, row_number() OVER (PARTITION BY trace_id ORDER BY path) - 1 AS position FROM tree")
def assemble(spark, sf_dir):
    spans = view(spark, sf_dir, "td_spans").select("trace_id", "span_id", "parent_span_id", "started_ns", "ord")
    return tree.preorder(tree.assemble_tree(spans, chains=False)).select("trace_id", "span_id", "depth", "position")


@register("G2_ancestry", f"{_TREE} SELECT trace_id, span_id, chain[i] AS ancestor_id, (depth + 1 - i)::INT AS distance FROM (SELECT *, unnest(range(1, depth + 1)) AS i FROM tree) q")
def ancestry(spark, sf_dir):
    return tree.ancestry(tree.assemble_tree(view(spark, sf_dir, "td_spans")))


@register("G3_span_positions", f"{_TREE} SELECT trace_id, span_id, depth, CASE WHEN depth = 0 THEN '' ELSE chain[2] END AS branch_span_id FROM tree")
def positions(spark, sf_dir):
    return tree.span_positions(view(spark, sf_dir, "td_spans"))[0]




@register("G8_collapse_subtrees", f"{_TREE} SELECT trace_id, span_id FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree f WHERE f.kind = 3 AND f.status = 1 AND f.trace_id = t.trace_id AND f.span_id = t.parent_span_id)")
def collapse(spark, sf_dir):
    spans = tree.assemble_tree(view(spark, sf_dir, "td_spans"), chains=False)
    return tree.collapse_subtrees(spans, spans.where("kind = 3 AND status = 1")).select("trace_id", "span_id")


_GAPS = f""", roots AS (SELECT trace_id, started_ns AS r0, ended_ns AS r1, CASE WHEN ended_ns - started_ns <= 0 THEN 0 ELSE greatest(1, (ended_ns - started_ns) // {WIDTH}) END AS min_ns FROM tree WHERE depth = 0),
  kids AS (SELECT k.*, p.started_ns AS p0, p.ended_ns AS p1, p.depth AS p_depth, p.path AS p_path, r.min_ns,
    greatest(p.started_ns, coalesce(max(k.ended_ns) OVER (PARTITION BY k.trace_id, k.parent_span_id ORDER BY k.started_ns, k.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p.started_ns)) AS f
    FROM tree k JOIN tree p ON p.trace_id = k.trace_id AND p.span_id = k.parent_span_id JOIN roots r ON r.trace_id = k.trace_id WHERE r.min_ns > 0),
  raw_gaps AS (SELECT trace_id, parent_span_id, p_depth, p_path, min_ns, f AS g0, started_ns AS g1 FROM kids WHERE started_ns > f
    UNION ALL SELECT trace_id, parent_span_id, any_value(p_depth), any_value(p_path), any_value(min_ns), greatest(max(ended_ns), any_value(p0)), any_value(p1) FROM kids GROUP BY trace_id, parent_span_id),
  gaps AS (SELECT trace_id, 'gap:' || parent_span_id || ':' || (row_number() OVER (PARTITION BY trace_id, parent_span_id ORDER BY g0) - 1) AS span_id, parent_span_id, g0, g1, p_depth + 1 AS depth, p_path FROM raw_gaps WHERE g1 - g0 >= min_ns)"""


@register("E3_gaps", f"{_TREE}{_GAPS} SELECT trace_id, span_id, parent_span_id, g0 AS started_ns, g1 AS ended_ns, g1 - g0 AS duration_ns, depth FROM gaps")
def gaps(spark, sf_dir):
    found = timeline.gaps(tree.assemble_tree(view(spark, sf_dir, "td_spans"), chains=False), WIDTH)
    return found.select("trace_id", "span_id", "parent_span_id", "started_ns", "ended_ns", "duration_ns", "depth")


_RANKED = f""", ranked AS (SELECT *, depth > 0 AND n > {ROWS} AND r >= {ROWS} AS collapsed FROM (SELECT *,
    row_number() OVER (PARTITION BY trace_id, parent_span_id ORDER BY duration_ns DESC, started_ns, ord) AS r, count(*) OVER (PARTITION BY trace_id, parent_span_id) AS n FROM tree) q),
  buckets AS (SELECT trace_id, 'rollup:' || parent_span_id AS span_id, parent_span_id, '(+' || count(*) || ' more)' AS name, CASE WHEN bool_or(status = 2) THEN 2 ELSE 1 END AS status,
    min(started_ns) AS started_ns, max(ended_ns) AS ended_ns, sum(duration_ns)::BIGINT AS duration_ns, any_value(depth) AS depth, any_value(path[:-2]) AS p_path FROM ranked WHERE collapsed GROUP BY trace_id, parent_span_id)"""


@register("E5_rollup_rank", f"{_TREE}{_RANKED} SELECT trace_id, span_id, r AS rank, collapsed FROM ranked")
def rollup_rank(spark, sf_dir):
    return timeline.ranked(tree.assemble_tree(view(spark, sf_dir, "td_spans"), chains=False), ROWS).select("trace_id", "span_id", "rank", "collapsed")


@register("D5_rollup_bucket", f"{_TREE}{_RANKED} SELECT trace_id, span_id, name, status, started_ns, ended_ns, duration_ns, depth FROM buckets")
def rollup_bucket(spark, sf_dir):
    found = timeline.rollup_buckets(tree.assemble_tree(view(spark, sf_dir, "td_spans"), chains=False), ROWS)
    return found.select("trace_id", "span_id", "name", "status", "started_ns", "ended_ns", "duration_ns", "depth")


_BARS = f""", folded AS (SELECT trace_id, span_id FROM ranked WHERE collapsed),
  hidden AS (SELECT DISTINCT c.trace_id, c.span_id FROM (SELECT trace_id, span_id, unnest(chain) AS a FROM ranked) c JOIN folded f ON f.trace_id = c.trace_id AND f.span_id = c.a),
  shown AS (SELECT trace_id, span_id, name, status, started_ns, ended_ns, duration_ns, depth, list_transform(path, lambda x: [x[1], 1, x[2]]) AS k FROM ranked r
      WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.trace_id = r.trace_id AND h.span_id = r.span_id)
    UNION ALL SELECT trace_id, span_id, '(gap)', 1, g0, g1, g1 - g0, depth, list_append(list_transform(p_path, lambda x: [x[1], 1, x[2]]), [g0, 2, 0]) FROM gaps g
      WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.trace_id = g.trace_id AND h.span_id = g.parent_span_id)
    UNION ALL SELECT trace_id, span_id, name, status, started_ns, ended_ns, duration_ns, depth, list_append(list_transform(p_path, lambda x: [x[1], 1, x[2]]), [started_ns, 3, 0]) FROM buckets b
      WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.trace_id = b.trace_id AND h.span_id = b.parent_span_id)),
  scaled AS (SELECT s.*, r1 - r0 AS span, least({WIDTH}, greatest(0, round((started_ns - r0)::DOUBLE * ({WIDTH}.0::DOUBLE / (r1 - r0)::DOUBLE))::BIGINT)) AS o,
      greatest(1, round((ended_ns - started_ns)::DOUBLE * ({WIDTH}.0::DOUBLE / (r1 - r0)::DOUBLE))::BIGINT) AS w FROM shown s JOIN roots r ON r.trace_id = s.trace_id)"""
_WATERFALL = f"""{_TREE}{_GAPS}{_RANKED}{_BARS} SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY k) - 1 AS position, span_id, name, depth, status,
  CASE WHEN span <= 0 THEN 0 WHEN o + w > {WIDTH} AND o = {WIDTH} THEN {WIDTH - 1} ELSE o END AS "offset",
  CASE WHEN span <= 0 THEN {WIDTH} WHEN o + w > {WIDTH} THEN greatest(1, {WIDTH} - o) ELSE w END AS width, ended_ns - started_ns AS bar_duration_ns, duration_ns AS work_ns FROM scaled"""


@register("M1_waterfall", _WATERFALL)
def waterfall(spark, sf_dir):
    return timeline.waterfall(view(spark, sf_dir, "td_spans"), WIDTH, ROWS)


def _pairs(spark, sf_dir):
    """Spans, and every customer's trace with the next one's."""
    spans = view(spark, sf_dir, "td_spans")
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k")).distinct()
    pairs = keys.join(keys.select((F.col("k") - 1).alias("k")), "k").select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("a"), F.concat(F.lit("c"), (F.col("k") + 1).cast("string")).alias("b"))
    return spans, pairs


@register("M2_diff_traces", f"""{_TREE}, pre AS (SELECT trace_id, name, depth, duration_ns, row_number() OVER (PARTITION BY trace_id ORDER BY path) - 1 AS position FROM tree),
  keyed AS (SELECT *, row_number() OVER (PARTITION BY trace_id, name, depth ORDER BY position) - 1 AS occurrence FROM pre),
  pairs AS (SELECT 'c' || x.o_custkey AS a, 'c' || y.o_custkey AS b FROM (SELECT DISTINCT o_custkey FROM orders) x JOIN (SELECT DISTINCT o_custkey FROM orders) y ON y.o_custkey = x.o_custkey + 1),
  sa AS (SELECT p.a, p.b, k.* FROM pairs p JOIN keyed k ON k.trace_id = p.a), sb AS (SELECT p.a, p.b, k.* FROM pairs p JOIN keyed k ON k.trace_id = p.b),
  j AS (SELECT coalesce(sa.a, sb.a) AS a, coalesce(sa.b, sb.b) AS b, coalesce(sa.name, sb.name) AS name, coalesce(sa.depth, sb.depth) AS depth, coalesce(sa.occurrence, sb.occurrence) AS occurrence,
        sa.position AS pa, sb.position AS pb, sa.duration_ns AS a_ns, sb.duration_ns AS b_ns
        FROM sa FULL OUTER JOIN sb ON sa.a = sb.a AND sa.b = sb.b AND sa.name = sb.name AND sa.depth = sb.depth AND sa.occurrence = sb.occurrence)
  SELECT a, b, row_number() OVER (PARTITION BY a, b ORDER BY pa IS NULL, coalesce(pa, pb)) - 1 AS position, CASE WHEN pa IS NULL THEN 'added' WHEN pb IS NULL THEN 'removed' ELSE 'matched' END AS kind,
    name, depth, occurrence, a_ns, b_ns, CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN b_ns - a_ns END AS delta_ns,
    CASE WHEN pa IS NULL THEN b_ns WHEN pb IS NULL THEN a_ns ELSE abs(b_ns - a_ns) END AS impact_ns FROM j""")
def diff(spark, sf_dir):
    spans, pairs = _pairs(spark, sf_dir)
    return timeline.diff_traces(spans, pairs)


@register("H2_diff_by_impact", ORACLES["M2_diff_traces"].replace("ORDER BY pa IS NULL, coalesce(pa, pb)", "ORDER BY CASE WHEN pa IS NULL THEN b_ns WHEN pb IS NULL THEN a_ns ELSE abs(b_ns - a_ns) END DESC, pa IS NULL, coalesce(pa, pb)"))
def diff_by_impact(spark, sf_dir):
    spans, pairs = _pairs(spark, sf_dir)
    return timeline.diff_traces(spans, pairs, by_impact=True)


_RUNS = ", runs AS (SELECT run_id, min(ts_ns) - 1000000000 AS r0, max(ts_ns) + 1000000000 AS r1 FROM td_marks GROUP BY run_id)"
_DEDUP = ", d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, name, ts_ns, child ORDER BY ord) AS rn FROM td_marks) q WHERE rn = 1)"


def _runs(rows):
    return rows.groupBy("run_id").agg((F.min("ts_ns") - 1_000_000_000).alias("started_ns"), (F.max("ts_ns") + 1_000_000_000).alias("ended_ns"))


@register("D3_dedup_marks", f"{sql('td_marks')}{_DEDUP} SELECT run_id, ord, name, ts_ns, child FROM d")
def dedup_marks(spark, sf_dir):
    return marks.dedup_marks(view(spark, sf_dir, "td_marks")).select("run_id", "ord", "name", "ts_ns", "child")


@register("E1_E2_mark_spans", f"""{sql('td_marks')}{_RUNS}{_DEDUP}, w AS (SELECT d.*, r0, r1, lead(ts_ns) OVER o AS nxt,
    min(CASE WHEN NOT child THEN ts_ns END) OVER (PARTITION BY d.run_id ORDER BY ts_ns, ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS sec,
    last_value(CASE WHEN NOT child THEN ord END IGNORE NULLS) OVER (PARTITION BY d.run_id ORDER BY ts_ns, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS par
    FROM d JOIN runs r ON r.run_id = d.run_id WINDOW o AS (PARTITION BY d.run_id ORDER BY ts_ns, ord))
  SELECT run_id, ord, name, child, CASE WHEN child THEN par END AS parent_ord, greatest(ts_ns, r0) AS started_ns, greatest(greatest(ts_ns, r0), coalesce(CASE WHEN child THEN nxt ELSE sec END, r1)) AS ended_ns FROM w""")
def mark_spans(spark, sf_dir):
    rows = view(spark, sf_dir, "td_marks")
    return marks.mark_spans(marks.dedup_marks(rows), _runs(rows))


_SUITES = f"""{sql('td_lines')}, cases AS (SELECT trace_id AS run_id, parent_span_id AS suite, row_number() OVER (PARTITION BY parent_span_id ORDER BY span_id) AS case_no, span_id AS name,
    (ended_ns - started_ns) // 1000000000 AS sec, status = 2 AS failed FROM td_lines),
  s AS (SELECT 'c' || o_custkey AS run_id, 'o' || o_orderkey AS suite, US(o_orderdate) // 1000000 % 500000 AS own FROM orders),
  runs AS (SELECT run_id, 0::BIGINT AS r0, 2000000000000000 AS r1 FROM s GROUP BY run_id),
  t AS (SELECT s.run_id, s.suite, own * 1000000000 AS own_ns, coalesce(sum(sec), 0)::BIGINT * 1000000000 AS cases_ns, coalesce(bool_or(failed), false) AS failed FROM s LEFT JOIN cases c ON c.suite = s.suite AND c.run_id = s.run_id GROUP BY s.run_id, s.suite, own),
  l AS (SELECT *, coalesce(sum(greatest(own_ns, cases_ns)) OVER (PARTITION BY run_id ORDER BY suite ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM t)""".replace("US(", "epoch_us(")


def _suites(spark, sf_dir):
    lines = view(spark, sf_dir, "td_lines")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("parent_span_id").orderBy("span_id"))
    cases = lines.select(F.col("trace_id").alias("run_id"), F.col("parent_span_id").alias("suite"), number.alias("case_no"), F.col("span_id").alias("case_name"), (S.idiv(F.col("ended_ns") - F.col("started_ns"), 1_000_000_000)).cast("double").alias("case_seconds"), (F.col("status") == 2).alias("failed"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    own = S.idiv(F.unix_micros(F.col("o_orderdate").cast("timestamp")), 1_000_000) % 500_000
    suites = orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("run_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("suite"), own.cast("double").alias("suite_seconds"))
    rows = suites.join(cases, ["run_id", "suite"], "left").withColumn("suite_name", F.col("suite"))
    runs = suites.select("run_id").distinct().select("run_id", F.lit(0).cast("bigint").alias("started_ns"), F.lit(2_000_000_000_000_000).alias("ended_ns"))
    return marks.suite_layout(rows, runs)


@register("E9_suite_layout", f"{_SUITES} SELECT l.run_id, suite, suite AS name, CASE WHEN failed THEN 2 ELSE 1 END AS status, least(r1, r0 + base) AS started_ns, least(r1, r0 + base + greatest(own_ns, cases_ns)) AS ended_ns FROM l JOIN runs r ON r.run_id = l.run_id")
def suite_layout(spark, sf_dir):
    return _suites(spark, sf_dir)[0]


@register("E9_case_layout", f"""{_SUITES}, i AS (SELECT c.*, coalesce(sum(sec * 1000000000) OVER (PARTITION BY c.run_id, c.suite ORDER BY case_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ins FROM cases c)
  SELECT i.run_id, i.suite, i.case_no, i.name, CASE WHEN i.failed THEN 2 ELSE 1 END AS status, least(r1, r0 + base + ins) AS started_ns, least(r1, r0 + base + ins + sec * 1000000000) AS ended_ns
  FROM i JOIN l ON l.run_id = i.run_id AND l.suite = i.suite JOIN runs r ON r.run_id = i.run_id""")
def case_layout(spark, sf_dir):
    return _suites(spark, sf_dir)[1]


@register("D4_go_test_fold", f"""WITH ev AS (SELECT user_id AS run_id, event_id AS ord, epoch_us(ts) * 1000 AS ts_ns, (['start', 'run', 'pass', 'fail', 'skip', 'output', 'pause'])[(event_id % 7 + 1)::INT] AS action,
    'p' || (event_id % 3) AS package, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 't' || (event_id % 5) END AS test FROM events),
  runs AS (SELECT run_id, min(ts_ns) + 1000000 AS r0, max(ts_ns) - 1000000 AS r1 FROM ev GROUP BY run_id),
  e AS (SELECT ev.* REPLACE (greatest(ts_ns, r0) AS ts_ns), r0, r1 FROM ev JOIN runs ON runs.run_id = ev.run_id WHERE action <> 'output'),
  g AS (SELECT run_id, package, test, arg_min(ts_ns, ord) FILTER (action IN ('start', 'run')) AS b, arg_max(ts_ns, ord) FILTER (action IN ('pass', 'fail', 'skip')) AS en, bool_or(action = 'fail') AS failed, any_value(r0) AS r0, any_value(r1) AS r1 FROM e GROUP BY run_id, package, test),
  a AS (SELECT * FROM g UNION ALL SELECT DISTINCT run_id, package, NULL, NULL::BIGINT, NULL::BIGINT, false, r0, r1 FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.run_id = g.run_id AND h.package = g.package AND h.test IS NULL)),
  c AS (SELECT *, least(coalesce(b, r0), r1) AS st FROM a)
  SELECT run_id, package, test, CASE WHEN failed THEN 2 ELSE 1 END AS status, st AS started_ns, CASE WHEN en IS NULL OR en < st OR en > r1 THEN r1 ELSE en END AS ended_ns FROM c""")
def go_test(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    action = F.element_at(F.array(*map(F.lit, ("start", "run", "pass", "fail", "skip", "output", "pause"))), (F.col("event_id") % 7 + 1).cast("int"))
    rows = ev.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), action.alias("action"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("package"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string"))).alias("test"))
    runs = rows.groupBy("run_id").agg((F.min("ts_ns") + 1_000_000).alias("started_ns"), (F.max("ts_ns") - 1_000_000).alias("ended_ns"))
    return marks.go_test_fold(rows, runs)


def _unit_spans(spark, sf_dir, name):
    rows = view(spark, sf_dir, name)
    return rows.select("trace_id", "span_id", F.col("unit").cast("bigint").alias("ord"), "duration_ns", F.col("unit").cast("string").alias("unit_text"), F.col("unblocks").alias("unblocks_text"))


#: longest path into every unit, units in order: a unit unblocks the next one or two
_FINISH = sql("td_units_ok").replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT trace_id, unit AS src, CAST(unnest(string_split(unblocks, ',')) AS BIGINT) AS dst FROM td_units_ok WHERE unblocks IS NOT NULL),
  p AS (SELECT trace_id, unit, duration_ns AS f, 1 AS n FROM td_units_ok u WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.trace_id = u.trace_id AND e.dst = u.unit)
        UNION ALL SELECT p.trace_id, u.unit, p.f + u.duration_ns, p.n + 1 FROM p JOIN e ON e.trace_id = p.trace_id AND e.src = p.unit JOIN td_units_ok u ON u.trace_id = e.trace_id AND u.unit = e.dst),
  m AS (SELECT trace_id, max(f) AS critical_ns FROM p GROUP BY trace_id)"""


@register("G4_critical_path", f"""{_FINISH} SELECT u.trace_id, 'ok' AS status, critical_ns, sum(duration_ns)::BIGINT AS total_work_ns, count(*) AS unit_count, coalesce(any_value(ec), 0) AS edge_count
  FROM td_units_ok u JOIN m ON m.trace_id = u.trace_id LEFT JOIN (SELECT trace_id AS t, count(*) AS ec FROM (SELECT DISTINCT trace_id, src, dst FROM e) q GROUP BY trace_id) c ON c.t = u.trace_id GROUP BY u.trace_id, critical_ns""")
def critical_ok(spark, sf_dir):
    return critical.critical_path(_unit_spans(spark, sf_dir, "td_units_ok"))[0].drop("path_count")


_PATH = _FINISH + """, best AS (SELECT trace_id, unit, max(f) AS f FROM p GROUP BY trace_id, unit),
  pred AS (SELECT b.trace_id, b.unit, min(e.src) AS src FROM best b JOIN td_units_ok u ON u.trace_id = b.trace_id AND u.unit = b.unit JOIN e ON e.trace_id = b.trace_id AND e.dst = b.unit
    JOIN best s ON s.trace_id = e.trace_id AND s.unit = e.src AND s.f + u.duration_ns = b.f GROUP BY b.trace_id, b.unit),
  walk AS (SELECT m.trace_id, min(unit) AS unit, 0 AS back FROM m JOIN best b ON b.trace_id = m.trace_id AND b.f = m.critical_ns GROUP BY m.trace_id
    UNION ALL SELECT w.trace_id, x.src, w.back + 1 FROM walk w JOIN pred x ON x.trace_id = w.trace_id AND x.unit = w.unit)
  SELECT w.trace_id, row_number() OVER (PARTITION BY w.trace_id ORDER BY back DESC) - 1 AS position, w.unit, u.span_id, u.duration_ns, b.f AS finish_ns
  FROM walk w JOIN td_units_ok u ON u.trace_id = w.trace_id AND u.unit = w.unit JOIN best b ON b.trace_id = w.trace_id AND b.unit = w.unit"""


@register("G4_critical_path_spans", _PATH)
def critical_spans(spark, sf_dir):
    return critical.critical_path(_unit_spans(spark, sf_dir, "td_units_ok"))[1]


@register("M8_validate_critical_path", "SELECT '' AS trace_id, '' AS violation WHERE false")
def critical_valid(spark, sf_dir):
    report, path, _ = critical.critical_path(_unit_spans(spark, sf_dir, "td_units_ok"))
    return critical.validate(report, path)


@register("C7_missing_units", f"""{sql('td_units')}, e AS (SELECT trace_id, span_id, CAST(unnest(string_split(unblocks, ',')) AS BIGINT) AS dst FROM td_units)
  SELECT trace_id, 'missing_unit' AS code, span_id, dst::INT AS unit FROM e WHERE NOT EXISTS (SELECT 1 FROM td_units u WHERE u.trace_id = e.trace_id AND u.unit = e.dst)""")
def missing_units(spark, sf_dir):
    return critical.build_graph(_unit_spans(spark, sf_dir, "td_units"))[2]


@register("G5_critical_path_lenient", f"{_FINISH} SELECT trace_id, critical_ns FROM m")
def critical_lenient(spark, sf_dir):
    # edges past the last unit are dropped, which leaves the graph of td_units_ok
    return critical.critical_path_lenient(_unit_spans(spark, sf_dir, "td_units"))


@register("G6_cycle_units", f"""{sql("td_units")} SELECT trace_id, span_id, unit::INT AS unit FROM (SELECT *, max(unit) OVER (PARTITION BY trace_id) AS m FROM td_units) q WHERE m >= 3 AND unit IN (1, 2)""")
def cycle_units(spark, sf_dir):
    """Units in a row, where the third also unblocks the second; those behind the cycle are not on it."""
    spans = _unit_spans(spark, sf_dir, "td_units")
    last = F.max("ord").over(Window.partitionBy("trace_id"))
    following = F.when(F.col("ord") < F.col("last"), (F.col("ord") + 1).cast("string"))
    spans = spans.withColumn("last", last).withColumn("unblocks_text", F.concat_ws(",", following, F.when((F.col("ord") == 2) & (F.col("last") >= 3), "1")))
    spans = spans.withColumn("unblocks_text", F.when(F.col("unblocks_text") != "", F.col("unblocks_text"))).drop("last")
    _, _, issues = critical.critical_path(spans)
    return issues.where("code = 'cycle'").select("trace_id", "span_id", "unit")


@register("M8_broken_reports", f"{_FINISH} SELECT trace_id, unnest(['path_sum'] || CASE WHEN length(trace_id) % 2 = 0 THEN ['path_count'] ELSE [] END) AS violation FROM m")
def critical_broken(spark, sf_dir):
    """Reports whose length, and for some whose count, was tampered with."""
    report, path, _ = critical.critical_path(_unit_spans(spark, sf_dir, "td_units_ok"))
    report = report.withColumn("critical_ns", F.col("critical_ns") - 1).withColumn("path_count", F.col("path_count") + (F.char_length("trace_id") + 1) % 2)
    return critical.validate(report, path)


@register("M9_span_detail", f"""{sql("td_spans")} SELECT trace_id, name, span_id, coalesce(parent_span_id, '(root)') AS parent, (['unspecified', 'internal', 'server', 'client', 'producer', 'consumer'])[kind + 1] AS kind,
  (['unset', 'ok', 'error'])[status + 1] AS status, {_DURATION.format("duration_ns")} AS duration, strftime(make_timestamp(started_ns // 1000), '%Y-%m-%d %H:%M:%S.%g') || ' UTC' AS started,
  strftime(make_timestamp(ended_ns // 1000), '%Y-%m-%d %H:%M:%S.%g') || ' UTC' AS ended, CASE WHEN kind = 1 THEN '(none)' ELSE rpad('label', 24, ' ') || ' (str) ' || name END AS attributes FROM td_spans""")
def span_detail(spark, sf_dir):
    label = F.array(F.struct(F.lit("label").alias("key"), F.lit("str").alias("value_type"), F.col("name").alias("value")))
    spans = view(spark, sf_dir, "td_spans").withColumn("attributes", F.when(F.col("kind") != 1, label))
    return timeline.span_detail(spans).withColumn("attributes", F.array_join("attributes", "\n"))


_BASE = f"""{sql("td_spans")}, base AS (SELECT * FROM td_spans WHERE kind <> 1), t AS (SELECT trace_id, min(started_ns) AS s, max(ended_ns) AS e, count(*) AS n FROM base GROUP BY trace_id),
  g AS (SELECT trace_id, max(ended_ns + 3600000000000000) AS e, count(*) AS n FROM td_spans WHERE kind = 1 AND length(trace_id) % 2 = 0 GROUP BY trace_id)"""


def _grafted(spark, sf_dir):
    """Orders as traces, to which the order lines of some are grafted a thousand hours late."""
    spans = view(spark, sf_dir, "td_spans")
    base = spans.where("kind <> 1")
    traces = base.groupBy("trace_id").agg(F.lit("run").alias("source"), F.min("started_ns").alias("started_ns"), F.max("ended_ns").alias("ended_ns"), (F.max("ended_ns") - F.min("started_ns")).alias("duration_ns"), F.count("*").alias("span_count"))
    late = spans.where("kind = 1 AND char_length(trace_id) % 2 = 0").withColumn("ended_ns", F.col("ended_ns") + 3_600_000_000_000_000).withColumn("duration_ns", F.col("ended_ns") - F.col("started_ns"))
    return graft.graft_spans(base, traces, late, "cargo")


@register("I2_D2_grafted_traces", f"""{_BASE} SELECT t.trace_id, CASE WHEN g.n IS NULL THEN 'run' ELSE 'cargo' END AS source, s AS started_ns, greatest(t.e, coalesce(g.e, t.e)) AS ended_ns,
  greatest(t.e, coalesce(g.e, t.e)) - s AS duration_ns, t.n + coalesce(g.n, 0) AS span_count FROM t LEFT JOIN g ON g.trace_id = t.trace_id""")
def grafted_traces(spark, sf_dir):
    return _grafted(spark, sf_dir)[1]


@register("I2_D2_grafted_roots", f"""{_BASE} SELECT b.trace_id, span_id, CASE WHEN parent_span_id IS NULL THEN greatest(ended_ns, coalesce(g.e, ended_ns)) ELSE ended_ns END AS ended_ns FROM base b LEFT JOIN g ON g.trace_id = b.trace_id
  UNION ALL SELECT trace_id, span_id, ended_ns + 3600000000000000 FROM td_spans WHERE kind = 1 AND length(trace_id) % 2 = 0""")
def grafted_roots(spark, sf_dir):
    return _grafted(spark, sf_dir)[0].select("trace_id", "span_id", "ended_ns")


@register("I1_union_marks", f"""{sql('td_marks')} SELECT run_id, name, ts_ns, child, count(*) AS n FROM (SELECT DISTINCT run_id, name, ts_ns, child FROM td_marks) q GROUP BY ALL""")
def union_marks(spark, sf_dir):
    """Marks of the socket and of the spool; every third is in both."""
    rows = view(spark, sf_dir, "td_marks")
    found = graft.union_marks(rows.where("ord % 3 <> 0"), rows.where("ord % 3 <> 1"))
    return found.groupBy("run_id", "name", "ts_ns", "child").agg(F.count("*").alias("n"))
