"""Positions and running totals over a whole table, range by range instead of in one task.

Rows are dealt by range of the key and cut there, so that every later job sees the same ranges; one total per range is
accumulated (as many rows as there are tasks), and each range adds its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import cut


def _in_ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(tasks, *keys).withColumn("_range", F.spark_partition_id()))


def _with_offsets(dealt: DataFrame, amount) -> DataFrame:
    """dealt with _before, the amount in all earlier ranges. Range totals are one row a task."""
    totals = dealt.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    before = totals.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_range")


def positions(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    dealt = _with_offsets(_in_ranges(df, keys), F.lit(1))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return dealt.withColumn(name, F.col("_before") + at).select(name, *df.columns)


def running_totals(df: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """key, name: the total of the amount over smaller keys. Keys are distinct."""
    dealt = _with_offsets(_in_ranges(df, [key]), F.col(amount))
    own = F.coalesce(F.sum(amount).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.select(key, (F.col("_before") + own).alias(name))
