"""Parquet tables of traces: six of them, written redacted and read back nested."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.redaction import DEFAULT_POLICY, Policy, redact_labels, redact_spans
from spanloom.operators.timeline import trace_summaries
from spanloom.operators.tree import first_wins
from spanloom.sources.readers import ATTRIBUTES, LINKS
from spanloom.sources.shared import discard, lean, materialize

TABLES = ("traces", "spans", "span_attributes", "span_diagnostics", "span_links", "span_link_attributes")


def write_spans(spans: DataFrame, path: str, source: str, policy: Policy | None = DEFAULT_POLICY, mode: str = "append", grain: str = "day", labels: DataFrame | None = None) -> None:
    """Write spans as tables under `path`, partitioned by source and start of the trace.

    `grain` (day, month, year) sets how coarse `trace_date` is; rows are rebalanced by it,
    so that a date gets few files and a busy one is split.  `labels` holds (trace_id,
    run_label).  Labels and root names are redacted with the spans.
    """
    with lean(spans.sparkSession):
        _write(spans, path, source, policy, mode, grain, labels)


def _write(spans: DataFrame, path: str, source: str, policy: Policy | None, mode: str, grain: str, labels: DataFrame | None) -> None:
    day = F.to_date(F.date_trunc(grain, F.timestamp_micros(F.expr("started_ns div 1000"))))
    spans = first_wins(spans, ["trace_id", "span_id"])
    # the start of its trace goes with every span, so that spans are not joined with traces for each table
    early = Window.partitionBy("trace_id").orderBy(F.asc_nulls_last("started_ns")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    date = F.to_date(F.date_trunc(grain, F.timestamp_micros(F.expr("_start div 1000"))))
    spans = spans.withColumn("_start", F.min("started_ns").over(early)).withColumn("trace_date", date).drop("_start")
    if policy:
        spans = redact_spans(spans, policy)
    # six tables are written from these rows
    spans = materialize(spans, "redacted")
    traces = trace_summaries(spans)
    traces = traces.join(labels.select("trace_id", "run_label"), "trace_id", "left") if labels is not None else traces.withColumn("run_label", F.lit(None).cast("string"))
    traces = (redact_labels(traces, policy) if policy else traces).withColumn("created_at", F.current_timestamp())
    keyed = spans.where(F.col("trace_id").isNotNull())
    links = keyed.select("trace_date", "trace_id", "span_id", F.posexplode("links").alias("link_index", "l"))
    tables = {
        "traces": traces.withColumn("trace_date", day),
        "spans": keyed.select("trace_date", "trace_id", "span_id", "parent_span_id", "name", "kind", "status", "started_ns", "ended_ns", "duration_ns"),
        "span_attributes": keyed.select("trace_date", "trace_id", "span_id", F.explode("attributes").alias("a")).select("trace_date", "trace_id", "span_id", "a.*"),
        "span_diagnostics": keyed.where("dropped_attributes_count > 0 OR dropped_links_count > 0").select("trace_date", "trace_id", "span_id", "dropped_attributes_count", "dropped_links_count"),
        "span_links": links.select("trace_date", "trace_id", "span_id", "link_index", F.col("l.trace_id").alias("linked_trace_id"), F.col("l.span_id").alias("linked_span_id"), "l.trace_state", "l.dropped_attributes_count", "l.flags"),
        "span_link_attributes": links.select("trace_date", "trace_id", "span_id", "link_index", F.explode("l.attributes").alias("a")).select("trace_date", "trace_id", "span_id", "link_index", "a.*"),
    }
    for name, rows in tables.items():
        rows.withColumn("source", F.lit(source)).hint("rebalance", "trace_date").write.mode(mode).partitionBy("source", "trace_date").parquet(posixpath.join(path, name))
    discard(spans)


def read_traces(spark: SparkSession, path: str, where: str = "true") -> DataFrame:
    """One row a trace: bounds, duration, root name, number of spans, label and time of writing."""
    return spark.read.parquet(posixpath.join(path, "traces")).where(where)


def read_spans(spark: SparkSession, path: str, where: str = "true") -> DataFrame:
    """Spans with nested attributes (by key) and links (by index); `ord` follows (started_ns, span_id).

    `where` may use trace_id, source and trace_date and is pushed into all scans.
    """
    from spanloom.operators.scan import position, scan

    t = {name: spark.read.parquet(posixpath.join(path, name)).where(where).drop("source", "trace_date") for name in TABLES[1:] if _has(spark, posixpath.join(path, name))}
    keys = ["trace_id", "span_id"]
    # attributes are placed by trace like the spans, so neither is shuffled again where they meet
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spans = scan(t["spans"], ["trace_id"], ["started_ns", "span_id"], before=position()).withColumn("ord", F.col("before") + 1).drop("before")
    attrs = lambda rows, by: rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("key", "value_type", "value"))).alias("attributes"))
    if "span_attributes" in t:
        spans = spans.join(attrs(t["span_attributes"].repartition("trace_id"), keys), keys, "left")
    else:
        spans = spans.withColumn("attributes", F.lit(None).cast(ATTRIBUTES))
    if "span_diagnostics" in t:
        spans = spans.join(t["span_diagnostics"], keys, "left")
    else:
        spans = spans.withColumn("dropped_attributes_count", F.lit(0).cast("bigint")).withColumn("dropped_links_count", F.lit(0).cast("bigint"))
    if "span_links" in t:
        links = t["span_links"]
        if "span_link_attributes" in t:
            links = links.join(attrs(t["span_link_attributes"], [*keys, "link_index"]), [*keys, "link_index"], "left")
        else:
            links = links.withColumn("attributes", F.lit(None).cast(ATTRIBUTES))
        body = F.struct("link_index", F.col("linked_trace_id").alias("trace_id"), F.col("linked_span_id").alias("span_id"), "trace_state", F.coalesce("attributes", F.array().cast(ATTRIBUTES)).alias("attributes"), "dropped_attributes_count", "flags")
        links = links.select(*keys, body.alias("l")).groupBy(*keys).agg(F.array_sort(F.collect_list("l")).alias("l"))
        links = links.select(*keys, F.transform("l", lambda x: x.dropFields("link_index")).cast(LINKS).alias("links"))
        spans = spans.join(links, keys, "left")
    else:
        spans = spans.withColumn("links", F.lit(None).cast(LINKS))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return spans.select("trace_id", "span_id", "parent_span_id", "name", "kind", "status", "started_ns", "ended_ns", "duration_ns", "ord", empty("attributes", ATTRIBUTES), empty("links", LINKS), zero("dropped_attributes_count"), zero("dropped_links_count"))


def _has(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written with at least one row (empty partitioned tables have no schema)."""
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def write_reports(rows: DataFrame, path: str, by: str = "trace_id", order: str = "position") -> None:
    """One JSON document a trace: its rows in order, as lines of text files."""
    columns = [order, *(c for c in rows.columns if c not in (by, order))]
    docs = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    docs.select(F.to_json(F.struct(by, "rows")).alias("value")).write.text(path)
