"""Joining what an adapter reports to the traces of its runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.marks import dedup_marks


def union_marks(*sources: DataFrame) -> DataFrame:
    """The marks of several sources (run_id, ord, name, ts_ns, child), each once; earlier sources come first."""
    rows = reduce(DataFrame.unionByName, (x.withColumn("_source", F.lit(k)) for k, x in enumerate(sources)))
    turn = F.row_number().over(Window.partitionBy("run_id").orderBy("_source", "ord"))
    return dedup_marks(rows.withColumn("ord", turn.cast("bigint")).drop("_source"))


def graft_spans(spans: DataFrame, traces: DataFrame, grafts: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Spans and traces after the spans in `grafts` have joined their traces.

    A grafted trace counts its spans anew and takes `source`; if a span ends after it,
    the trace and its first parentless span grow to that end.  Traces without grafts
    stay as they are, and grafts of unknown traces go.  Grafts come behind the spans
    that were there, in their own order.
    """
    known = grafts.join(traces.select("trace_id"), "trace_id", "left_semi")
    last = spans.groupBy("trace_id").agg(F.max("ord").alias("_last"))
    known = known.join(last, "trace_id", "left").withColumn("ord", F.col("ord") + F.coalesce("_last", F.lit(0))).drop("_last")
    every = spans.unionByName(known, allowMissingColumns=True)
    grafted = known.groupBy("trace_id").agg(F.lit(True).alias("_grafted"))
    root = F.min_by("span_id", F.when(F.col("parent_span_id").isNull(), F.col("ord")))
    totals = every.groupBy("trace_id").agg(F.max("ended_ns").alias("_end"), F.count("*").alias("_count"), root.alias("_root")).join(grafted, "trace_id")
    kept = totals.join(traces.select("trace_id", F.col("ended_ns").alias("_was")), "trace_id")
    grows = F.coalesce(F.col("_grafted") & (F.col("_end") > F.col("_was")), F.lit(False))
    new = traces.join(kept, "trace_id", "left")
    end = F.when(grows, F.col("_end")).otherwise(F.col("ended_ns"))
    new = new.withColumns({"ended_ns": end, "duration_ns": F.when(grows, F.col("_end") - F.col("started_ns")).otherwise(F.col("duration_ns")), "span_count": F.coalesce("_count", "span_count"), "source": F.when(F.col("_grafted"), source).otherwise(F.col("source"))})
    rows = every.join(kept, "trace_id", "left")
    here = grows & (F.col("span_id") == F.col("_root")) & F.col("parent_span_id").isNull()
    rows = rows.withColumns({"ended_ns": F.when(here, F.col("_end")).otherwise(F.col("ended_ns")), "duration_ns": F.when(here, F.col("_end") - F.col("started_ns")).otherwise(F.col("duration_ns"))})
    return rows.select(*every.columns), new.select(*traces.columns)
