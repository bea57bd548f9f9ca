"""Exact row positions and running sums without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_running_sum(rows: DataFrame, group: list[str], bucket: str, order: list[Column | str], value: Column, before: str, total: str) -> DataFrame:
    """Add the sum of ``value`` over the rows ``before`` each row of its group, and the group's ``total``.

    ``bucket`` is a column that rises with ``order`` and splits a group into
    bounded parts, so a hot group is summed by many tasks: buckets are summed
    (with map-side combine), these sums are added up before each bucket, and only
    the rows of one bucket are ordered together. Group columns must not be null.
    """
    of_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    so_far = Window.unboundedPreceding, Window.currentRow
    valued = rows.withColumn("__value", value)
    sums = valued.groupBy(*group, bucket).agg(F.sum("__value").alias("__sum"))
    earlier = F.sum("__sum").over(of_group.orderBy(bucket).rowsBetween(*so_far)) - F.col("__sum")
    offsets = sums.select(*group, bucket, earlier.alias("__earlier"), F.sum("__sum").over(of_group).alias(total))
    within = F.sum("__value").over(Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(*so_far)) - F.col("__value")
    return valued.join(offsets, [*group, bucket]).withColumn(before, F.col("__earlier") + within).drop("__earlier", "__value")


def with_positions(rows: DataFrame, group: list[str], bucket: str, order: list[Column | str], position: str, total: str) -> DataFrame:
    """Add the 0-based ``position`` of each row in its group and the group's row count ``total``."""
    return with_running_sum(rows, group, bucket, order, F.lit(1), position, total)
