"""Tables in the folder that all machines of a cluster share.

Every table that `materialize` writes is remembered and deleted when the driver ends;
`discard` deletes one earlier, `kept_alone` those that a step wrote on its way.
"""

from __future__ import annotations

import atexit
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: paths of the tables that stand, and the session that wrote each
_STANDING: dict[str, SparkSession] = {}
#: names of those that are in the catalog
_TABLES: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What `spark.checkpoint.dir` names.

    Where nothing is configured, a session on one machine (master local) gets a folder
    of its own; a cluster must name one.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        place = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = posixpath.join(shared_dir(spark), f"spanloom-{name}-{uuid.uuid4().hex}")
    _STANDING[path] = spark
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a new shared table and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._spanloom_path = path
    return found


def bucketed(df: DataFrame, name: str, by: str = "trace_id") -> DataFrame:
    """`materialize`, bucketed by `by`: joins and windows on it and more columns shuffle neither side.

    df should come from windows by `by` or from joins of such tables, so that a task
    writes whole buckets; else files are many and small.  Spark then has to take one key
    for all of a join's: the session's requireAllClusterKeysForCoPartition is set to false.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    table = posixpath.basename(path).replace("-", "_")
    df.write.option("compression", "zstd").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).format("parquet").saveAsTable(table)
    found = spark.table(table)
    found._spanloom_path = path
    _TABLES[path] = table
    return found


def discard(*tables: DataFrame | str | None) -> None:
    """Delete tables and folders that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        _delete(df if isinstance(df, str) else getattr(df, "_spanloom_path", None))


_STATES = "spark.sql.streaming.stateStore"
#: shuffle files go with their job, not when the driver's memory is next collected; states are packed tighter
#: and lie on disk with a bounded share of memory, as the keys of a long delay need not fit into it
_LEAN = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", f"{_STATES}.compression.codec": "zstd",
    f"{_STATES}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATES}.rocksdb.changelogCheckpointing.enabled": "true", f"{_STATES}.rocksdb.trackTotalNumberOfRows": "false", f"{_STATES}.rocksdb.compression": "zstd",
    f"{_STATES}.rocksdb.boundedMemoryUsage": "true", f"{_STATES}.rocksdb.maxMemoryUsageMB": "500",
}


#: rows that a partition of a shuffle inside `sized` holds on average at most
ROWS = 300_000
#: what AQE joins such partitions to, and how much of a file a task reads, so that few rows wait in a sort or a shuffle's buffer
_SIZED = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.files.maxPartitionBytes": "32m"}
#: rows are collected by groups that come one after the other; by hash, all would be sorted anew once there are 128 groups
_SIZED["spark.sql.execution.useObjectHashAggregateExec"] = "false"


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Tables written and streams started inside keep no shuffle files once a job, or a batch, has ended."""
    with _set(spark, _LEAN):
        yield


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables planned and written inside come from tasks that grow in number with `rows`, not in size.

    More partitions than the session names are used, never fewer; rows of one key stay together.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    with _set(spark, _SIZED | {"spark.sql.shuffle.partitions": str(parts)}):
        yield


def kept_alone(step: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of a step as a table, after which the tables that the step wrote are deleted."""
    before = set(_STANDING)
    found = materialize(step(), name)
    for path in set(_STANDING) - before - {found._spanloom_path}:
        _delete(path)
    return found


def _delete(path: str | None) -> None:
    spark = _STANDING.pop(path, None)
    if spark is None:
        return
    if path in _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_STANDING):
        try:
            _delete(path)
        except Exception:  # the session or its machine is gone; nothing is left to do
            return
