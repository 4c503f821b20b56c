"""Running totals over groups of any size.

A window over a whole group puts that group in one task. Here the order column
is cut into blocks of bounded length: totals run inside each block in parallel,
the block totals (one row per block) are accumulated, and the two are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apportion.functions.guards import whole

BLOCK_ROWS = 1 << 16


def running_sum(
    table: DataFrame,
    group: list[str],
    order: str,
    value: str,
    name: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the inclusive running total of ``value`` per group.

    ``order`` is an integer that identifies a row within its group, so a block
    never holds more than ``block_rows`` rows of one group.
    """
    keys = [*group, "__block"]
    blocked = table.withColumn("__block", whole(F.col(order), block_rows))
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = (
        blocked.groupBy(*keys)
        .agg(F.sum(value).alias("__total"))
        .select(*keys, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    )
    return (
        blocked.withColumn(name, F.sum(value).over(inside))
        .join(totals, keys)
        .withColumn(name, F.col(name) + F.col("__before"))
        .drop("__block", "__before")
    )
