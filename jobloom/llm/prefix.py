"""Ranks and running totals over groups of any size, without a task that gets a whole group."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobloom.runtime import settle


def running_total(rows: DataFrame, group: str, part: Column, order: list, value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group that come before.

    ``part`` grows with ``order`` and cuts a group into parts of bounded size:
    one window sums within a part, another over the totals of the parts.
    """
    parted = rows.withColumn("_part", part).withColumn("_value", value)
    totals = parted.groupBy(group, "_part").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(group, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = parted.withColumn("_inner", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return inner.join(starts, [group, "_part"]).withColumn(name, F.col("_start") + F.col("_inner")).drop("_part", "_inner", "_start", "_value")


def ranged(rows: DataFrame, order: list, name: str) -> DataFrame:
    """The rows dealt out by ranges of ``order`` and written down, with the number of their range in ``_range``.

    The number grows with the order; writing fixes it, since a range
    partitioning samples anew each time it runs.
    """
    return settle(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Add the rank from 0 of every row in the order of the whole table."""
    parts = ranged(rows, order, "ranged")
    sizes = parts.groupBy("_range").agg(F.count("*").alias("_n"))  # one row per range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return parts.withColumn(name, place).join(F.broadcast(starts), "_range").withColumn(name, (F.col(name) + F.col("_start")).cast("long")).drop("_range", "_start")
