"""Deterministic dataset splits by hash order and quotas, connected groups, and audits for leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklume.sources.shared_tables import SharedTables

SPLITS = ("train", "calibration", "val", "test")
RATIOS = (0.70, 0.10, 0.10, 0.10)


def hash_order(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by ``|``, in hex: the same order on every engine."""
    return F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def quotas(groups: DataFrame, ratios: tuple[float, ...] = RATIOS, names: tuple[str, ...] = SPLITS) -> DataFrame:
    """Largest-remainder apportionment of the number of ``groups``: split, quota, and the first place of its slice."""
    total = groups.agg(F.count("*").alias("n"))
    spark = groups.sparkSession
    wanted = spark.createDataFrame([(i, s, r) for i, (s, r) in enumerate(zip(names, ratios, strict=True))], "place int, split string, ratio double")
    exact = wanted.crossJoin(F.broadcast(total)).withColumn("floor", F.floor(F.round(F.col("n") * F.col("ratio"), 9)).cast("long"))
    exact = exact.withColumn("rest", F.round(F.col("n") * F.col("ratio") - F.col("floor"), 9))
    every = Window.partitionBy(F.lit(0))
    ranked = exact.withColumns({"i": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), "place")), "left": F.col("n") - F.sum("floor").over(every)})
    given = ranked.withColumn("quota", F.col("floor") + F.when(F.col("i") <= F.col("left"), 1).otherwise(0))
    return given.select("place", "split", "quota", (F.sum("quota").over(every.orderBy("place")) - F.col("quota")).alias("first"))


def split_by_hash(groups: DataFrame, key: str, seed: str, ratios: tuple[float, ...] = RATIOS) -> DataFrame:
    """``groups`` with ``split``: consecutive slices of the hash order, as many groups as each quota says.

    A group's place is counted in two steps, within a range of hashes and over
    the ranges' totals, so that no task sees all groups.
    """
    hashed = groups.withColumn("_h", hash_order(seed, F.col(key))).withColumn("_range", F.substring("_h", 1, 2))
    totals = hashed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = totals.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # 256 rows at most
    placed = hashed.join(F.broadcast(before), "_range").withColumn("_place", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_h", key)) - 1)
    slices = F.broadcast(quotas(groups, ratios))
    return placed.join(slices, (F.col("_place") >= F.col("first")) & (F.col("_place") < F.col("first") + F.col("quota"))).select(*groups.columns, "split")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of an undirected graph of string nodes; component is the least node.

    Alternating large and small stars, each round written to the shared folder
    and started from there; ends when a round changes nothing.
    """
    tables = SharedTables(edges.sparkSession, "components")
    now = tables.write(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "0")
    alone = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"))
    state, step = None, 0
    while (fresh := tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())) != state:
        state, step = fresh, step + 1
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        now = tables.write(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), str(step))
        tables.drop(str(step - 1))
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.union(roots).union(alone.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def leakage_audit(rows: DataFrame, split: str, fields: list[str]) -> DataFrame:
    """Per identity field: values, those in more than one split, rows without a value, and a status."""
    long = rows.select(split, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("p")).select(split, "p.*")
    values = long.where("value is not null").groupBy("field", "value").agg(F.countDistinct(split).alias("splits"))
    found = values.groupBy("field").agg(F.count("*").alias("values"), F.sum(F.when(F.col("splits") > 1, 1).otherwise(0)).alias("leaking"))
    missing = long.groupBy("field").agg(F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).alias("missing"))
    status = F.when(F.col("missing") > 0, "provenance_incomplete").when(F.col("leaking") > 0, "leakage_detected").otherwise("ok")
    return missing.join(found, "field", "left").select("field", F.coalesce("values", F.lit(0)).alias("values"), F.coalesce("leaking", F.lit(0)).alias("leaking"), "missing", status.alias("status"))


def isolation_overlap(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """Per field how many values both tables have: all must be zero for isolated sets."""
    long = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("p")).select("p.*").where("value is not null")
    shared = long(left).intersect(long(right)).groupBy("field").agg(F.count("*").alias("overlap"))
    names = left.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return names.join(F.broadcast(shared), "field", "left").select("field", F.coalesce("overlap", F.lit(0)).alias("overlap"))


def partition_plan(rows: DataFrame, order: list[str], world: int, batch: int) -> DataFrame:
    """Rank floor(i W / n)-wise contiguous ranges of the ordered rows, cut into as many steps on every rank; adds rank and step."""
    spark = rows.sparkSession
    tables = SharedTables(spark, "plan")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = tables.write(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"))
    placed = placed.join(F.broadcast(before), "_part").withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    # The rank r holds rows floor(r n / W) to floor((r + 1) n / W) - 1.
    rank = F.floor(((F.col("_i") + 1) * world - 1) / F.col("_total")).cast("long")
    first = lambda r: F.floor(r * F.col("_total") / world).cast("long")
    ranked = placed.withColumn("rank", rank).withColumns({"_first": first(F.col("rank")), "_size": first(F.col("rank") + 1) - first(F.col("rank"))})
    steps = F.ceil(F.ceil(F.col("_total") / world) / batch)
    step = F.floor(((F.col("_i") - F.col("_first") + 1) * steps - 1) / F.col("_size")).cast("long")
    return ranked.withColumn("step", step).drop("_part", "_before", "_total", "_i", "_first", "_size")
