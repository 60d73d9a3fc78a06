"""Sections and child spans from point marks, and the layout of test suites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import scalars as S
from spanloom.operators.scan import last_before, next_after, scan, sum_before
from spanloom.sources.shared import materialize


def dedup_marks(marks: DataFrame) -> DataFrame:
    """Exact duplicates of (name, ts_ns, child) within a run go; the first stays."""
    turn = F.row_number().over(Window.partitionBy("run_id", "name", "ts_ns", "child").orderBy("ord"))
    return marks.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def mark_parts(marks: DataFrame) -> DataFrame:
    """`dedup_marks` without columns besides, as an aggregation; parts of a run merge by it too."""
    return marks.groupBy("run_id", "name", "ts_ns", "child").agg(F.min("ord").alias("ord"))


def mark_spans(marks: DataFrame, runs: DataFrame) -> DataFrame:
    """One span a mark: run_id, ord, name, child, parent_ord, started_ns, ended_ns.

    marks: run_id, ord, name, ts_ns, child; runs: run_id, started_ns, ended_ns.  Marks
    of a run are ordered by time, then arrival.  A section ends at the next section, a
    child at the next mark of any kind, the last at the run's end.  A child belongs to
    the section before it; parent_ord is null under the run's root.  A run with very many
    marks is laid out by many tasks.
    """
    runs = runs.select("run_id", F.col("started_ns").alias("run_start"), F.col("ended_ns").alias("run_end"))
    of_section = lambda c: F.when(~F.col("child"), F.col(c))
    rows = scan(marks, ["run_id"], ["ts_ns", "ord"], next_mark=next_after(F.col("ts_ns")), next_section=next_after(of_section("ts_ns")), section=last_before(of_section("ord")))
    rows = rows.join(runs, "run_id")
    end = F.coalesce(F.when(F.col("child"), F.col("next_mark")).otherwise(F.col("next_section")), "run_end")
    rows = rows.withColumn("parent_ord", F.when(F.col("child"), F.col("section"))).withColumn("end", end).withColumn("started_ns", F.greatest("ts_ns", "run_start"))
    return rows.select("run_id", "ord", "name", "child", "parent_ord", "started_ns", F.greatest("started_ns", "end").alias("ended_ns"))


def suite_layout(cases: DataFrame, runs: DataFrame, extend: bool = False) -> tuple[DataFrame, DataFrame]:
    """Synthesised times of test suites and their cases, one after the other.

    cases: run_id, suite (position), suite_seconds, suite_name, case_no, case_seconds,
    case_name, failed; a suite without cases has one row with a null case_no.  Suites lie
    end to end, each as long as its own time or the sum of its cases if that is more;
    cases lie end to end inside.  Nothing passes the end of the run; `extend` first
    lengthens the run to the report's own duration.  Runs of very many suites and suites of
    very many cases are laid out by many tasks.
    """
    rows = cases.withColumn("case_ns", S.seconds_to_ns(F.coalesce("case_seconds", F.lit(0.0)))).withColumn("own_ns", S.seconds_to_ns(F.coalesce("suite_seconds", F.lit(0.0))))
    suites = rows.groupBy("run_id", "suite").agg(F.first("suite_name").alias("suite_name"), F.max("own_ns").alias("own_ns"), F.sum("case_ns").alias("cases_ns"), F.max(F.coalesce("failed", F.lit(False))).alias("failed"), F.count("case_no").alias("count"))
    suites = suites.withColumn("length", F.greatest("own_ns", "cases_ns"))
    suites = materialize(suites, "suites")
    sized = suites.select("run_id", "suite", "count")
    suites = scan(suites, ["run_id"], ["suite"], at=sum_before(F.col("length")))
    bounds = runs.select("run_id", F.col("started_ns").alias("r0"), F.col("ended_ns").alias("r1"))
    if extend:
        total = suites.groupBy("run_id").agg(F.sum("length").alias("total"))
        bounds = bounds.join(total, "run_id").select("run_id", "r0", F.greatest("r1", F.col("r0") + F.col("total")).alias("r1"))
    # sums are kept in decimals, so that long reports saturate at the run's end
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    end = lambda x: F.least(wide("r1"), x).cast("bigint")
    suites = suites.join(bounds, "run_id")
    out = suites.select("run_id", "suite", S.suite_name(F.col("suite_name")).alias("name"), F.when(F.col("failed"), 2).otherwise(1).alias("status"), end(wide("r0") + wide("at")).alias("started_ns"), end(wide("r0") + wide("at") + wide("length")).alias("ended_ns"))
    own = scan(rows.where("case_no IS NOT NULL"), ["run_id", "suite"], ["case_no"], counts=sized, inside=sum_before(F.col("case_ns")))
    own = own.join(suites.select("run_id", "suite", "at", "r0", "r1"), ["run_id", "suite"])
    base = wide("r0") + wide("at") + wide("inside")
    tests = own.select("run_id", "suite", "case_no", F.col("case_name").alias("name"), F.when(F.col("failed"), 2).otherwise(1).alias("status"), end(base).alias("started_ns"), end(base + wide("case_ns")).alias("ended_ns"))
    return out, tests


def go_test_parts(events: DataFrame) -> DataFrame:
    """What events say of every package and test: first beginning, last finish, whether any failed.

    events: run_id, ord, ts_ns, action, package, test.
    """
    begin, finish, at = F.col("action").isin("start", "run"), F.col("action").isin("pass", "fail", "skip"), F.struct("ord", "ts_ns")
    return events.where("action <> 'output'").groupBy("run_id", "package", "test").agg(
        F.min(F.when(begin, at)).alias("begun"), F.max(F.when(finish, at)).alias("done"), F.max(F.col("action") == "fail").alias("failed")
    )


def go_test_merged(parts: DataFrame) -> DataFrame:
    """Parts of the same package or test as one."""
    return parts.groupBy("run_id", "package", "test").agg(F.min("begun").alias("begun"), F.max("done").alias("done"), F.max("failed").alias("failed"))


def go_test_spans(parts: DataFrame, runs: DataFrame) -> DataFrame:
    """Packages and tests as spans within their run: run_id, package, test (null for packages), status and times.

    Every test implies its package.  Missing and backward bounds come from the run.
    """
    runs = runs.select("run_id", F.col("started_ns").alias("r0"), F.col("ended_ns").alias("r1"))
    found = parts.join(runs, "run_id").select("run_id", "package", "test", F.greatest("begun.ts_ns", F.when(F.col("begun").isNotNull(), F.col("r0"))).alias("b"), F.greatest("done.ts_ns", F.when(F.col("done").isNotNull(), F.col("r0"))).alias("e"), "failed", "r0", "r1")
    implied = found.select("run_id", "package", F.lit(None).cast("string").alias("test"), F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("bigint").alias("e"), F.lit(False).alias("failed"), "r0", "r1")
    implied = implied.distinct().join(found.where("test IS NULL").select("run_id", "package"), ["run_id", "package"], "left_anti")
    every = found.withColumn("test", F.col("test").cast("string")).unionByName(implied.select(*found.columns))
    start = F.least(F.coalesce("b", "r0"), "r1")
    end = F.when(F.col("e").isNull() | (F.col("e") < start) | (F.col("e") > F.col("r1")), F.col("r1")).otherwise(F.col("e"))
    return every.select("run_id", "package", "test", F.when(F.col("failed"), 2).otherwise(1).alias("status"), start.alias("started_ns"), end.alias("ended_ns"))


def go_test_fold(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Packages and tests from test events.

    The first start or run event begins a span, the last pass, fail or skip ends it, any
    fail makes it an error.
    """
    return go_test_spans(go_test_parts(events), runs)
