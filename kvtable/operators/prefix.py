"""Running sums and row numbers over a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def running_sum(df: DataFrame, order: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """All columns and ``out``: the sum of ``value`` up to and with the row, by the BIGINT column ``order``.

    Rows are cut into blocks of ``block`` consecutive order values; one
    aggregation gives the sum of each block, a window over these small sums
    gives each block's start, and the rows are summed within their block.
    """
    rows = df.select("*", F.expr(f"`{order}` div {block}").alias("_block"), value.cast("bigint").alias("_value"))
    sums = rows.groupBy("_block").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(starts, "_block").withColumn(out, F.col("_start") + F.sum("_value").over(inside))
    return summed.drop("_block", "_value", "_start")
