"""Running values in the order of a key, for keys of any size.

A window puts all rows of a key into one task.  Here only keys of a bounded number of
rows go that way; rows of larger ones are sorted by key and order over many tasks, every
sort partition is scanned for itself, and what the partitions before (or behind) it in the
same key add up to is carried in, one row for each partition and key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spanloom.sources.shared import materialize

#: rows of a key that one task takes
HOT = 1_000_000


@dataclass(frozen=True)
class Running:
    """A value that depends on the rows before a row, or behind it if `backward`.

    `local` is the value over the window of the rows at hand that come earlier in its
    direction, `total` what a whole partition hands on (`at` orders its rows in that
    direction), `carry` what all partitions before one hand on, `merge` both as one.
    """

    local: Callable[[WindowSpec], Column]
    total: Callable[[Column], Column]
    carry: Callable[[Column, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]
    backward: bool = False


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def position() -> Running:
    """How many rows come before."""
    return sum_before(F.lit(1).cast("bigint"))


def sum_before(x: Column) -> Running:
    """Sum of `x` over the rows before, 0 for the first."""
    zero = F.lit(0)
    return Running(lambda w: F.coalesce(F.sum(x).over(_before(w)), zero), lambda at: F.sum(x), lambda t, w: F.coalesce(F.sum(t).over(_before(w)), zero), lambda a, b: a + b)


def max_before(x: Column) -> Running:
    """Greatest `x` of the rows before."""
    return Running(lambda w: F.max(x).over(_before(w)), lambda at: F.max(x), lambda t, w: F.max(t).over(_before(w)), F.greatest)


def last_before(x: Column, backward: bool = False) -> Running:
    """The nearest `x` before that is not null."""
    near = lambda c, w: F.last(c, ignorenulls=True).over(_before(w))
    return Running(lambda w: near(x, w), lambda at: F.max_by(x, F.when(x.isNotNull(), at)), near, F.coalesce, backward)


def next_after(x: Column) -> Running:
    """The nearest `x` behind that is not null."""
    return last_before(x, backward=True)


def scan(rows: DataFrame, keys: list[str], order: list[str], hot: int | None = None, counts: DataFrame | None = None, **values: Running) -> DataFrame:
    """Add `values` to rows, each by the rows of the same keys in ascending `order`.

    Null keys are one key, null orders come first.  `order` should tell the rows of a key apart;
    of rows that it does not, any may come first.  Rows are counted by key once, so rows
    that are costly to compute should be materialised before, or come with their `counts`
    (keys, count; keys of one row may be missing).
    """
    hot = HOT if hot is None else hot
    large = (rows.groupBy(*keys).count() if counts is None else counts).where(F.col("count") > hot).select(F.struct(*keys).alias("_key"))
    large = materialize(large, "large") if counts is None else large
    if large.isEmpty():
        return _windows(rows, keys, order, values)
    keyed = rows.withColumn("_key", F.struct(*keys))  # in a struct, nulls are equal
    few = _windows(keyed.join(large, "_key", "left_anti"), keys, order, values)
    return few.unionByName(_spread(keyed.join(large, "_key", "left_semi"), order, values)).drop("_key")


def _windows(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Running]) -> DataFrame:
    """`values` by plain windows; backward ones run over the reversed order, as frames that end behind cost squares."""
    forth, back = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumns({name: v.local(back if v.backward else forth) for name, v in values.items()})


def _spread(rows: DataFrame, order: list[str], values: dict[str, Running]) -> DataFrame:
    """`values` of keys whose rows lie in many sort partitions."""
    rows = materialize(rows, "hot")
    rows = rows.repartitionByRange("_key", *order).sortWithinPartitions("_key", *order)
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "sorted")
    totals = rows.groupBy("_part", "_key").agg(*(v.total(-F.col("_at") if v.backward else F.col("_at")).alias(name) for name, v in values.items()))
    forth, back = Window.partitionBy("_key").orderBy("_part"), Window.partitionBy("_key").orderBy(F.desc("_part"))
    carried = totals.select("_part", "_key", *(v.carry(F.col(name), back if v.backward else forth).alias(f"_carried_{name}") for name, v in values.items()))
    found = _windows(rows, ["_part", "_key"], ["_at"], values).join(materialize(carried, "carried"), ["_part", "_key"])
    merged = {name: v.merge(F.col(name), F.col(f"_carried_{name}")) for name, v in values.items()}
    return found.withColumns(merged).drop("_at", "_part", *(f"_carried_{name}" for name in values))
