"""Gap segmentation of object tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(track: DataFrame, key: str, t: str, max_gap: float | Column, eps: float = 1e-9) -> DataFrame:
    """Adds ``segment_id``: 0 for a key's first rows, one more after each gap over ``max_gap`` + ``eps``.

    One shuffle on ``key``; both windows share its partitioning and order.
    """
    order = Window.partitionBy(key).orderBy(t)
    step = F.col(t) - F.lag(t).over(order)
    marked = track.withColumn("_new", F.when(step > F.lit(max_gap) + eps, 1).otherwise(0))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("segment_id", F.sum("_new").over(upto)).drop("_new")
