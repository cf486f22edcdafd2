"""Running sums in an order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.staging import written


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` down to and with each row, within ``group`` by ``order``.

    Rows are dealt out by ranges of group and order and written once; sums inside a range are taken there, and what
    earlier ranges of the group sum to (a row for each range and group in it) is added. A group of any size is spread
    over ranges. Rows that tie in ``order`` follow each other in any way.
    """
    keys = [*group, *order]
    dealt = rows.withColumn("_value", value.cast("long")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_range", F.shiftright("_at", 33))
    sums = held.groupBy("_range", *group).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_{g}") for g in group], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("_range") == F.col("_r")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    summed = held.withColumn("_inside", F.sum("_value").over(inside)).join(before, same)
    return summed.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_before") + F.col("_inside")).alias(name))
