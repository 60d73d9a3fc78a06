"""Adapters that follow the output of runs: lines come in, spans come out when a run has ended.

An adapter says how lines become rows, how rows fold into small parts, how parts of
several batches merge, and how the parts of an ended run become spans.  All four are
DataFrame steps, so a run of any size is folded by its packages, tests or marks before
rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators import marks
from spanloom.sources.readers import go_test_events, mark_rows
from spanloom.streaming.spans import BUCKETS, latest


@dataclass(frozen=True)
class StreamAdapter:
    parse: Callable[[DataFrame], DataFrame]
    fold: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    spans: Callable[[DataFrame, DataFrame], DataFrame]


GO_TEST = StreamAdapter(go_test_events, marks.go_test_parts, marks.go_test_merged, marks.go_test_spans)
MARKS = StreamAdapter(mark_rows, marks.mark_parts, marks.mark_parts, marks.mark_spans)

#: adapters by name; users may add their own
ADAPTERS: dict[str, StreamAdapter] = {"gotest": GO_TEST, "marks": MARKS}


def follow(lines: DataFrame, ends: DataFrame, adapter: StreamAdapter | str, state: str, spans: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Fold a stream of lines (run_id, ord, value) and write the spans of runs that ended.

    ends: a stream of run_id, started_ns, ended_ns, one row when a run is over; a repeated
    row corrects the earlier one.  Lines that come after their run's end change its spans,
    which are written anew under the later batch; readers take `latest_spans`.  Lines of a
    run that has not ended wait as parts.  Lines longer than a mebibyte, blank and
    malformed ones count for nothing, as the readers have it.

    A batch writes its parts and ends to partitions of its own, hence a repeated batch
    replaces itself, and reads earlier ones only in the buckets of its ended runs.
    """
    adapter = ADAPTERS[adapter] if isinstance(adapter, str) else adapter
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("int")
    nothing = lambda kind: F.lit(None).cast(kind)
    both = lines.select("run_id", "ord", "value", nothing("bigint").alias("started_ns"), nothing("bigint").alias("ended_ns")).unionByName(
        ends.select("run_id", nothing(dict(lines.dtypes)["ord"]).alias("ord"), nothing("string").alias("value"), "started_ns", "ended_ns")
    )

    def kept(found: DataFrame, kind: str, number: int) -> DataFrame:
        """All rows of a kind so far, those of this batch included."""
        found = found.withColumn("bucket", bucket)
        found.write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/{kind}/batch={number}")
        every = found.sparkSession.read.schema(found.withColumn("batch", F.lit(0).cast("bigint")).schema).parquet(f"{state}/{kind}")
        return every.where(F.col("batch") <= number)

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            parts = kept(adapter.fold(adapter.parse(batch.where("value IS NOT NULL").select("run_id", "ord", "value"))), "parts", number)
            ended = kept(batch.where("value IS NULL AND ended_ns IS NOT NULL").select("run_id", "started_ns", "ended_ns"), "ends", number)
            touched = batch.select("run_id", bucket.alias("bucket")).distinct()
            # at most BUCKETS numbers
            buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]
            bounds = ended.where(F.col("bucket").isin(buckets)).groupBy("run_id").agg(F.max(F.struct("batch", "ended_ns", "started_ns")).alias("e"))
            due = bounds.select("run_id", "e.started_ns", "e.ended_ns").join(touched.select("run_id"), "run_id", "left_semi")
            own = parts.where(F.col("bucket").isin(buckets)).drop("bucket", "batch").join(due.select("run_id"), "run_id", "left_semi")
            adapter.spans(adapter.merge(own), due).write.mode("overwrite").parquet(f"{spans}/batch={number}")
        finally:
            batch.unpersist()

    writer = both.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_spans(spark: SparkSession, spans: str) -> DataFrame:
    """The spans that `follow` wrote last for every ended run."""
    return latest(spark, spans, "run_id")
