"""One shape for what build and test reports say: an adapter takes reports and runs and gives spans.

Reports are rows (run_id, value), for line-based formats with `ord`; runs are rows
(run_id, started_ns, ended_ns).  The spans of every adapter have the same columns, so those
of any number of reports of a run can be united with its root and sections and grafted.
A format of one's own is one entry of ADAPTERS.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import scalars as S
from spanloom.operators import marks
from spanloom.sources import readers

#: key and parent_key name spans within their run; parent_key is null below the run's root
SPANS = f"run_id, key string, parent_key string, name string, status int, started_ns bigint, ended_ns bigint, attributes {readers.ATTRIBUTES}"
ROOT = "root"


def _spans(rows: DataFrame, key: Column, parent, name, status, attributes: Column | None = None) -> DataFrame:
    none = F.array().cast(readers.ATTRIBUTES)
    parent = F.lit(None).cast("string") if parent is None else parent
    return rows.select("run_id", key.alias("key"), parent.alias("parent_key"), name.alias("name"), status.cast("int").alias("status"), "started_ns", "ended_ns", (none if attributes is None else attributes).alias("attributes"))


def cargo(reports: DataFrame, runs: DataFrame, **_) -> DataFrame:
    """Units and, below them, their sections."""
    rows = readers.cargo_spans(readers.cargo_units(reports), runs)
    unit = F.concat(F.lit("cargo/"), F.col("ord").cast("string"))
    key = F.when(F.col("section").isNull(), unit).otherwise(F.concat(unit, F.lit("/"), F.col("section").cast("string")))
    return _spans(rows, key, F.when(F.col("section").isNotNull(), unit), F.col("name"), F.lit(1), F.col("attributes"))


def gotest(reports: DataFrame, runs: DataFrame, module: str = "", **_) -> DataFrame:
    """Packages, without the prefix of the module of the run, and below them their tests."""
    rows = marks.go_test_fold(readers.go_test_events(reports), runs)
    package = F.concat(F.lit("gotest/"), F.col("package"))
    label = S.package_label(F.col("package"), module) if module else F.col("package")
    key = F.when(F.col("test").isNull(), package).otherwise(F.concat(package, F.lit("//"), F.col("test")))
    return _spans(rows, key, F.when(F.col("test").isNotNull(), package), F.coalesce("test", label), F.col("status"))


def junit(reports: DataFrame, runs: DataFrame, extend: bool = False, **_) -> DataFrame:
    """Suites, end to end, and below them their cases; `extend` lengthens runs to their reports."""
    suites, cases = marks.suite_layout(readers.junit_cases(reports), runs, extend)
    suite = F.concat(F.lit("junit/"), F.col("suite").cast("string"))
    own = _spans(suites, suite, None, F.col("name"), F.col("status"))
    return own.unionByName(_spans(cases, F.concat(suite, F.lit("/"), F.col("case_no").cast("string")), suite, F.col("name"), F.col("status")))


#: report format -> (reports, runs, options) to spans
ADAPTERS: dict[str, Callable[..., DataFrame]] = {"cargo": cargo, "gotest": gotest, "junit": junit}


def names() -> list[str]:
    return sorted(ADAPTERS)


def lookup(name: str) -> Callable[..., DataFrame]:
    if name not in ADAPTERS:
        raise ValueError(f"unknown report format {name!r}; there are {', '.join(names())}")
    return ADAPTERS[name]


def sections(found: DataFrame) -> DataFrame:
    """What `mark_spans` gives as spans of the common shape; those of child marks carry the mark of sub-sections."""
    key = lambda c: F.concat(F.lit("mark/"), F.col(c).cast("string"))
    own = F.when(F.col("child"), F.array(F.struct(F.lit("cargo.section").alias("key"), F.lit("str").alias("value_type"), F.col("name").alias("value")))).otherwise(F.array().cast(readers.ATTRIBUTES))
    return _spans(found, key("ord"), key("parent_ord"), F.col("name"), F.lit(1), own)


def run_spans(runs: DataFrame, reports: dict[str, DataFrame], found: DataFrame | None = None, **options) -> DataFrame:
    """Root, sections (`found`, from `mark_spans`) and all reports of every run as one set of spans.

    runs: run_id, started_ns, ended_ns and, where known, name and status.  trace_id is the
    run's id; spans that would pass the run's end stay as their adapter gave them.
    """
    here = lambda c, default: F.col(c) if c in runs.columns else F.lit(default)
    root = _spans(runs, F.lit(ROOT), None, here("name", "run"), here("status", 1))
    parts = [lookup(name)(rows, runs, **options) for name, rows in reports.items()]
    if found is not None:
        parts.append(sections(found))
    below = reduce(DataFrame.unionByName, parts, root.where("false"))
    every = root.unionByName(below.withColumn("parent_key", F.coalesce("parent_key", F.lit(ROOT))))
    order = Window.partitionBy("run_id").orderBy(F.col("key") != ROOT, "started_ns", "key")
    return every.select(
        F.col("run_id").cast("string").alias("trace_id"), F.col("key").alias("span_id"), F.col("parent_key").alias("parent_span_id"), "name", F.lit(1).alias("kind"), "status", "started_ns", "ended_ns",
        (F.col("ended_ns") - F.col("started_ns")).alias("duration_ns"), F.row_number().over(order).cast("bigint").alias("ord"), "attributes",
    )
