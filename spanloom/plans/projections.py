"""Trace-shaped views of the test tables, as one SQL text for Spark and for DuckDB.

Customers are traces, their orders and order lines are spans; orders are also build
graphs and test suites, events are marks, conversations are model calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_HOUR = "CAST(3600000000000 AS BIGINT)"
TABLES = ("customer", "orders", "lineitem", "events", "conversations", "documents", "pages")

#: name -> (views it needs, text); {us:x} is microseconds since the epoch, {t} a table
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "td_lines": ((), f"""SELECT 'c' || o.o_custkey AS trace_id,
        'l' || l.l_orderkey || '-' || l.l_linenumber || '-' || l.l_partkey || '-' || l.l_suppkey AS span_id,
        'o' || l.l_orderkey AS parent_span_id, 'line ' || l.l_linenumber AS name, 1 AS kind,
        CASE l.l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS status,
        US(o.o_orderdate) * 1000 + (l.l_partkey % 48) * {_HOUR} AS started_ns,
        US(o.o_orderdate) * 1000 + (l.l_partkey % 48) * {_HOUR} + CAST(l.l_quantity AS BIGINT) * {_HOUR} AS ended_ns
        FROM <lineitem> l JOIN <orders> o ON o.o_orderkey = l.l_orderkey"""),
    "td_orders": (("td_lines",), """SELECT 'c' || o.o_custkey AS trace_id, 'o' || o.o_orderkey AS span_id, 'c' || o.o_custkey AS parent_span_id,
        o.o_orderpriority AS name, 3 AS kind, CASE o.o_orderstatus WHEN 'P' THEN 2 WHEN 'F' THEN 1 ELSE 0 END AS status,
        US(o.o_orderdate) * 1000 AS started_ns, coalesce(m.e, US(o.o_orderdate) * 1000) AS ended_ns
        FROM <orders> o LEFT JOIN (SELECT parent_span_id AS p, max(ended_ns) AS e FROM td_lines GROUP BY parent_span_id) m ON m.p = 'o' || o.o_orderkey"""),
    "td_roots": (("td_orders",), """SELECT trace_id, trace_id AS span_id, CAST(NULL AS VARCHAR(32)) AS parent_span_id, 'customer' AS name,
        2 AS kind, 1 AS status, min(started_ns) AS started_ns, max(ended_ns) AS ended_ns FROM td_orders GROUP BY trace_id"""),
    "td_spans": (("td_roots", "td_orders", "td_lines"), """SELECT *, ended_ns - started_ns AS duration_ns,
        CAST(row_number() OVER (PARTITION BY trace_id ORDER BY started_ns, span_id, ended_ns, status) AS BIGINT) AS ord
        FROM (SELECT * FROM td_roots UNION ALL SELECT * FROM td_orders UNION ALL SELECT * FROM td_lines) q"""),
    # the first of equal span ids counts wherever a trace is read as a tree or stored
    "td_kept": (("td_spans",), """SELECT trace_id, span_id, parent_span_id, name, kind, status, started_ns, ended_ns, duration_ns, ord
        FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, span_id ORDER BY ord) AS turn FROM td_spans) q WHERE turn = 1"""),
    "td_units": (("td_lines",), """SELECT trace_id, unit, span_id, duration_ns,
        CASE WHEN unit % 3 <> 2 THEN (unit + 1) || ',' || (unit + 2) ELSE CAST(unit + 2 AS VARCHAR(20)) END AS unblocks
        FROM (SELECT parent_span_id AS trace_id, span_id, ended_ns - started_ns AS duration_ns,
              row_number() OVER (PARTITION BY parent_span_id ORDER BY span_id) - 1 AS unit FROM td_lines) q"""),
    "td_units_ok": (("td_units",), """SELECT trace_id, unit, span_id, duration_ns,
        CASE WHEN unit % 3 <> 2 AND unit + 2 <= m THEN (unit + 1) || ',' || (unit + 2)
             WHEN unit % 3 <> 2 AND unit + 1 <= m THEN CAST(unit + 1 AS VARCHAR(20))
             WHEN unit % 3 = 2 AND unit + 2 <= m THEN CAST(unit + 2 AS VARCHAR(20)) END AS unblocks
        FROM (SELECT *, max(unit) OVER (PARTITION BY trace_id) AS m FROM td_units) q"""),
    "td_marks": ((), """SELECT user_id AS run_id, event_id AS ord, event_type AS name, US(ts) * 1000 AS ts_ns,
        event_type IN ('click', 'view') AS child FROM <events>"""),
    "td_usage": ((), """SELECT 'v' || conv_id AS trace_id, 'v' || conv_id || '-' || turn AS span_id,
        CASE WHEN turn = 0 THEN NULL ELSE 'v' || conv_id || '-' || (turn - 1) END AS prev, turn * 1000 AS started_ns,
        CASE WHEN conv_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider,
        CASE WHEN conv_id % 3 = 1 THEN 'cumulative' ELSE 'delta' END AS mode,
        CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS input_tokens,
        CAST(length(text) AS BIGINT) AS output_tokens, turn % 4 = 3 AS compacted FROM <conversations>"""),
    "td_text": ((), """SELECT 'd' || doc_id AS id, text FROM <documents>
        UNION ALL SELECT 'v' || conv_id || '-' || turn, text FROM <conversations>
        UNION ALL SELECT 'p' || page_id, url FROM <pages>"""),
}


def _needed(name: str) -> list[str]:
    out: list[str] = []
    for need in VIEWS[name][0]:
        out += [x for x in _needed(need) if x not in out]
    return [*out, name]


def sql(name: str, duckdb: bool = True) -> str:
    """`WITH` clause that defines a view and all it needs, without what selects from it."""
    text = ", ".join(f"{x} AS ({VIEWS[x][1]})" for x in _needed(name))
    if duckdb:
        text = text.replace("US(", "epoch_us(")
        for t in TABLES:
            text = text.replace(f"<{t}>", t)
    else:
        text = text.replace("US(o.o_orderdate)", "unix_micros(CAST(o.o_orderdate AS TIMESTAMP))").replace("US(ts)", "unix_micros(CAST(ts AS TIMESTAMP))")
        for t in TABLES:
            text = text.replace(f"<{t}>", "{" + t + "}")
    return "WITH " + text


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`td_spans` by one shuffle of orders and lines by order and one of spans by trace.

    The SQL text reads the lines three times.  Here numbers are shuffled and ids are spelt
    out behind the shuffle, so rows are placed by trace_id and later windows by it need no other.
    """
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = table("orders").selectExpr(
        "'c' || o_custkey AS trace_id", "o_orderkey", "o_orderpriority", "CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'F' THEN 1 ELSE 0 END AS o_status", "unix_micros(CAST(o_orderdate AS TIMESTAMP)) * 1000 AS o_ns"
    ).withColumn("nth", F.monotonically_increasing_id())
    lines = table("lineitem").selectExpr(
        "l_orderkey AS o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS l_status", f"(l_partkey % 48) * {_HOUR} AS wait", f"CAST(l_quantity AS BIGINT) * {_HOUR} AS work", "true AS line"
    )
    rows = orders.join(lines, "o_orderkey", "left").withColumn("l_end", F.expr("o_ns + wait + work"))
    rows = rows.withColumn("o_end", F.max("l_end").over(Window.partitionBy("o_orderkey")))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("o_orderkey", "nth").orderBy("l_linenumber")))
    # what is null is filtered behind `inline`, as a function of arrays keeps its whole step from being compiled
    both = F.expr("""array(
        CASE WHEN line THEN struct(1 AS kind, l_status AS status, CAST(NULL AS STRING) AS name, l_linenumber, l_partkey, l_suppkey, o_ns + wait AS started_ns, l_end AS ended_ns) END,
        CASE WHEN turn = 1 THEN struct(3 AS kind, o_status AS status, o_orderpriority AS name, CAST(NULL AS INT) AS l_linenumber, NULL AS l_partkey, NULL AS l_suppkey, o_ns AS started_ns, coalesce(o_end, o_ns) AS ended_ns) END)""")
    rows = rows.select("trace_id", "o_orderkey", F.inline(both)).where("kind IS NOT NULL").repartition("trace_id")
    trace, order = Window.partitionBy("trace_id"), "CASE WHEN kind = 3 THEN {} END"
    rows = rows.withColumns({"r_start": F.min(F.expr(order.format("started_ns"))).over(trace), "r_end": F.max(F.expr(order.format("ended_ns"))).over(trace), "turn": F.row_number().over(trace.orderBy("started_ns"))})
    spelt = F.expr("""array(
        CASE WHEN kind = 1 THEN struct('l' || o_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS span_id, 'o' || o_orderkey AS parent_span_id, 'line ' || l_linenumber AS name, kind, status, started_ns, ended_ns)
             ELSE struct('o' || o_orderkey AS span_id, trace_id AS parent_span_id, name, kind, status, started_ns, ended_ns) END,
        CASE WHEN turn = 1 THEN struct(trace_id AS span_id, CAST(NULL AS STRING) AS parent_span_id, 'customer' AS name, 2 AS kind, 1 AS status, r_start AS started_ns, r_end AS ended_ns) END)""")
    rows = rows.select("trace_id", F.inline(spelt)).where("kind IS NOT NULL").withColumn("duration_ns", F.expr("ended_ns - started_ns"))
    return rows.withColumn("ord", F.row_number().over(trace.orderBy("started_ns", "span_id", "ended_ns", "status")).cast("bigint"))


def _units(spark: SparkSession, sf_dir: str, ok: bool) -> DataFrame:
    """`td_units` or `td_units_ok` by one shuffle of orders and lines by trace_id, here the id of the order.

    The SQL text shuffles them by order, by parent and by trace; graphs need no other shuffle after this one.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("'o' || o_orderkey AS trace_id", "unix_micros(CAST(o_orderdate AS TIMESTAMP)) * 1000 AS o_ns")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("'o' || l_orderkey AS trace_id", "l_linenumber", "l_partkey", "l_suppkey", f"CAST(l_quantity AS BIGINT) * {_HOUR} AS work")
    rows = orders.join(lines, "trace_id").withColumn("span_id", F.expr("'l' || substr(trace_id, 2) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"))
    order = Window.partitionBy("trace_id")
    rows = rows.withColumn("unit", F.row_number().over(order.orderBy("span_id")) - 1)
    unblocks = "CASE WHEN unit % 3 <> 2 THEN (unit + 1) || ',' || (unit + 2) ELSE CAST(unit + 2 AS STRING) END"
    if ok:
        rows = rows.withColumn("m", F.count("*").over(order) - 1)
        unblocks = """CASE WHEN unit % 3 <> 2 AND unit + 2 <= m THEN (unit + 1) || ',' || (unit + 2)
            WHEN unit % 3 <> 2 AND unit + 1 <= m THEN CAST(unit + 1 AS STRING) WHEN unit % 3 = 2 AND unit + 2 <= m THEN CAST(unit + 2 AS STRING) END"""
    duration = "CASE WHEN o_ns IS NOT NULL AND l_partkey IS NOT NULL THEN work END AS duration_ns"
    return rows.selectExpr("trace_id", "unit", "span_id", duration, f"{unblocks} AS unblocks")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "td_spans":
        return _spans(spark, sf_dir)
    if name in ("td_units", "td_units_ok"):
        return _units(spark, sf_dir, name == "td_units_ok")
    text = sql(name, duckdb=False)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(f"{text} SELECT * FROM {name}", **frames)
