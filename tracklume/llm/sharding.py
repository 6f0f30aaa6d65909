"""Contiguous shards of near-equal bytes, cut from a global prefix sum.

``byte_shards`` range-partitions the (small) keys, adds up each partition,
carries the partition totals forward as offsets, and cuts the running sum at
equal targets.  No row passes through the driver or a single task: what is
gathered is one total a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklume.llm.columns import aside
from tracklume.llm.scratch import Scratch, partitions


def byte_shards(rows: DataFrame, key: str, size: Column, shards: int) -> DataFrame:
    """``rows`` with ``size``, ``shard`` (0 to shards - 1, contiguous in ``key`` order) and ``slot`` (gapless from 0 in a shard).

    A row goes to the shard in whose equal share of all bytes its middle byte
    lies, so a shard is off its target by less than one row at either end.
    Null keys come first; rows of equal keys keep one order and may be cut
    apart.  Equal texts are no rows of one place: each counts with its own
    bytes and goes where its key stands.  An empty table gives an empty result.
    Columns named ``size``, ``shard`` or ``slot`` are replaced; others stay.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "sharding")
    own, names = aside(rows.withColumn("size", size.cast("long")), "shard", "slot")
    keyed = own.withColumnRenamed(names["size"], "size").withColumn("_tie", F.monotonically_increasing_id())
    key = names[key] if key != "size" else key
    ranged = keyed.repartitionByRange(partitions(spark), F.col(key).asc_nulls_first(), "_tie")
    # The ranges are sampled: written once, so that totals and rows see the same ones.
    ranged = scratch.write(ranged.withColumn("_part", F.spark_partition_id()), "ranged")

    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_before"))
    everything = totals.agg(F.sum("_bytes").alias("_total"))
    # One row a partition of the shuffle: small enough to broadcast at any size of the data.
    ahead = F.broadcast(offsets.crossJoin(F.broadcast(everything)))

    order = Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_first(), "_tie")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_within", F.coalesce(F.sum("size").over(upto), F.lit(0))).join(ahead, "_part")
    middle = F.col("_before") + F.col("_within") + F.col("size") / 2
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / F.greatest("_total", F.lit(1))), F.lit(shards - 1)).cast("int"))

    # Slots: how many rows of the shard lie in earlier partitions, then the place in this one.
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_part", "shard").orderBy(F.col(key).asc_nulls_first(), "_tie")
    return (
        placed.withColumn("_place", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "_part"])
        .withColumn("slot", F.col("_first") + F.col("_place"))
        .select(*(F.col("size" if x == "size" else held).alias(x) for x, held in names.items()), "shard", "slot")
    )
