"""Ranks over a whole table, without a window that holds it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from coppice.functions.scratch import written


def ranked(df: DataFrame, column: str, name: str = "rank", first: int = 1) -> DataFrame:
    """``column, name``: the distinct non-null values of a column with their place in ascending order.

    Values are sorted in ranges; a range's first place is the number of values in the ranges before it.
    Only one number a range is ever brought together. The ranges are written once, as they are drawn
    from a sample and must not change between counting and numbering.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranges = written(values.repartitionByRange(column).select(column, F.spark_partition_id().alias("__range")))
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sizes.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__start"))
    order = W.partitionBy("__range").orderBy(column)
    placed = ranges.withColumn("__at", F.row_number().over(order)).join(starts, "__range")
    return placed.select(column, (F.col("__start") + F.col("__at") - 1 + first).cast("int").alias(name))
