"""Keyed table operations: latest-wins upsert, delete by key, incremental skip, global ids, dedupe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``current`` with the rows of ``changes``; on a common key the change wins."""
    return current.join(changes.select(*keys).distinct(), list(keys), "left_anti").select(*current.columns).unionByName(changes.select(*current.columns))


def delete_ids(current: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return current.join(ids.select(key).distinct(), key, "left_anti").select(*current.columns)


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Rows of ``work`` whose key is not done yet; all of them with ``force``."""
    return work if force else work.join(done.select(*keys).distinct(), list(keys), "left_anti").select(*work.columns)


def global_ids(df: DataFrame, order: Sequence[str], name: str = "global_id", rows_per_range: int = 1_000_000) -> DataFrame:
    """Dense ids 0..n-1 in the given total order, without one task that numbers everything.

    Rows are range-partitioned into ranges of about ``rows_per_range`` and written with the range they fell
    into; the driver gets one count a range, and rows are numbered inside their range.
    """
    n = df.count()
    ranges = max(1, -(-n // rows_per_range))
    dealt = written(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = sorted(tuple(r) for r in dealt.groupBy("__range").count().collect())  # one row a range
    before, at = [], 0
    for part, rows in counts:
        before.append((part, at))
        at += rows
    offsets = df.sparkSession.createDataFrame(before, "__range int, __before long")
    inside = Window.partitionBy("__range").orderBy(*order)
    numbered = dealt.withColumn("__n", F.row_number().over(inside) - 1).join(F.broadcast(offsets), "__range")
    return numbered.select(*df.columns, (F.col("__before") + F.col("__n")).alias(name))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of every key in the given order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def drop_repeats(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value equals that of the row just before are dropped."""
    before = F.lag(F.struct(value)).over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("__b", before).where(F.col("__b").isNull() | ~F.col(f"__b.{value}").eqNullSafe(F.col(value))).drop("__b")


def number_within(df: DataFrame, partition: Sequence[str], order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    inside = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.row_number().over(inside) - 1 + start)
