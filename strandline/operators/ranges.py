"""Ranks and running sums over whole tables, without a task that sees all rows: ranges of the order, a total per range, windows within."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Stage = Callable[[DataFrame, str], DataFrame]


def running(rows: DataFrame, order: list[Column], sums: list[str], stage: Stage, name: str) -> DataFrame:
    """rows with _rank (from 1) and, for each column in sums, _before_<column>: its sum over all rows before in the order.

    The order is cut into ranges as Spark samples them and written, by ``stage(df, name)``, so that a row keeps its range. One row per range
    then gives what lies before the range. Rows that tie in the whole order get different ranks; a null in a sum counts as 0.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stage(dealt.withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()}), name)
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_all_{c}") for c in sums))
    # One row per range of the shuffle.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = totals.select(F.col("_part").alias("_base"), zero(F.sum("_n").over(earlier)).alias("_from"), *(zero(F.sum(f"_all_{c}").over(earlier)).alias(f"_from_{c}") for c in sums))
    own = Window.partitionBy("_part").orderBy("_pos")
    prior = own.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(base, F.col("_part") == F.col("_base"))
    added = [(F.col("_from") + F.row_number().over(own)).alias("_rank"), *((F.col(f"_from_{c}") + zero(F.sum(c).over(prior))).alias(f"_before_{c}") for c in sums)]
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), *added)


def places(rows: DataFrame, groups: list[str], order: list[Column], stage: Stage, name: str) -> DataFrame:
    """rows with _place, from 1 in the order within their group (equal values of the columns groups, nulls too), and _count, the group's rows.

    Ranges of (groups, order) split a large group, and a row per range and group tells where in the group the range begins; so no task
    sorts a whole group. Rows that tie in the whole order get different places. ``stage`` as in running().
    """
    by = [*(F.col(g).asc_nulls_first() for g in groups), *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = stage(dealt.withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()}), name)
    runs = dealt.groupBy("_part", *groups).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(*groups)  # a row per range that the group is in
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_part", *groups, (before - F.col("_first") + 1).alias("_shift"), F.sum("_n").over(own).alias("_count"))
    same = reduce(lambda a, b: a & b, (F.col(f"d.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups), F.col("d._part") == F.col("r._part"))
    return dealt.alias("d").join(runs.alias("r"), same).select(*(F.col(f"d.`{c}`") for c in rows.columns), (F.col("_pos") + F.col("_shift")).alias("_place"), "_count")


def least_from(rows: DataFrame, order: list[Column], value: Column, stage: Stage, name: str) -> DataFrame:
    """rows with _least, the smallest value from the row on to the end of the order: the minimum within the row's range, and those of the later ranges."""
    dealt = rows.withColumn("_value", value).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stage(dealt.withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()}), name)
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # one row per range of the shuffle
    ends = dealt.groupBy("_part").agg(F.min("_value").alias("_end")).select(F.col("_part").alias("_base"), F.min("_end").over(later).alias("_end"))
    own = F.min("_value").over(Window.partitionBy("_part").orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.join(ends, F.col("_part") == F.col("_base"))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), F.least(own, F.col("_end")).alias("_least"))
