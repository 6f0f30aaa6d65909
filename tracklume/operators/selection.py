"""Exact order statistics of many groups at once, by rounds of range counts.

Equal values of a group are one row with their number, written once: what
follows grows with the different values alone.  A round asks Spark for a sketch
of each group's remaining rows, takes from it a range that must hold the wanted
rank, counts what lies below, and keeps what lies inside.  What is left of a
rank - LEFT different values - is ranked by a window.  No group's values ever
gather in one task, and no buffer holds them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklume.sources.shared_tables import SharedTables

#: Different values of a group and rank that a window may rank.
LEFT = 100_000
#: Cuts of a sketch, and its accuracy: the rank of a cut is off by at most a share of 1 / ACCURACY.
CUTS, ACCURACY = 128, 10_000

Rank = Callable[[Column], Column]


def order_statistics(rows: DataFrame, groups: list[str], value: str, ranks: dict[str, Rank], count: Column | None = None) -> DataFrame:
    """groups, ``n``, and under each name the value of that rank: ``ranks`` maps a name to a function from n to 1 .. n.

    Null values don't count, and a group without others isn't there; null group
    keys are a group; NaN is the greatest value.  Ties take as many ranks as
    they have rows.  A rank outside 1 .. n is null.
    A row stands for ``count`` equal ones.
    """
    tables = SharedTables(rows.sparkSession, "selection")
    key = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}) if groups else F.lit("")
    valued = rows.where(F.col(value).isNotNull()).select(key.alias("_g"), *groups, F.col(value).cast("double").alias("_v"), (F.lit(1) if count is None else count).cast("long").alias("_n"))
    values = tables.write(valued.groupBy("_g", *groups, "_v").agg(F.sum("_n").alias("c")), "values")
    sizes = values.groupBy("_g", *groups).agg(F.sum("c").alias("n"), F.count("*").alias("d"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("k")) for name, rank in ranks.items())))
    wanted = tables.write(sizes.select("_g", *groups, "n", "d", asked.alias("_a")).select("_g", *groups, "n", "d", "_a.*"), "wanted")

    # Ranks of a group that are equal are looked for once; m counts different values.
    state = wanted.where("k between 1 and n").groupBy("_g", "k").agg(F.max("d").alias("m")).withColumn("below", F.lit(0).cast("long"))
    small, large = state.where(F.col("m") <= LEFT), state.where(F.col("m") > LEFT)
    left = values.select("_g", "_v", "c")
    found = [_ranked(left, small.drop("m"), "_g")]
    held = left.join(large, "_g")
    level = 0
    while not large.isEmpty():
        held = tables.write(held, f"held-{level}")
        cuts = F.percentile_approx("_v", [i / CUTS for i in range(CUTS + 1)], ACCURACY)
        sketch = held.groupBy("_g", "k").agg(cuts.alias("cuts"))
        inside = held.join(sketch, ["_g", "k"])
        bins = inside.groupBy("_g", "k", F.size(F.filter("cuts", lambda x: x <= F.col("_v"))).alias("bin")).agg(F.sum("c").alias("c"), F.count("*").alias("m"), F.min("_v").alias("first"), F.max("_v").alias("last"), F.first("below").alias("b"))
        upto = F.col("b") + F.sum("c").over(Window.partitionBy("_g", "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        narrowed = tables.write(bins.withColumn("upto", upto).where("k <= upto and k > upto - c").select("_g", "k", "m", (F.col("upto") - F.col("c")).alias("below"), "first", "last"), f"ranges-{level}")
        found.append(narrowed.where("m = 1").select("_g", "k", F.col("first").alias("value")))
        open_ = narrowed.where("m > 1")
        kept = held.select("_g", "k", "_v", "c").join(open_, ["_g", "k"]).where("_v between first and last").drop("first", "last")
        held = tables.write(kept, f"kept-{level}")
        found.append(_ranked(held.where(F.col("m") <= LEFT).select("_g", "k", "_v", "c"), open_.where(F.col("m") <= LEFT).select("_g", "k", "below"), "_g", "k"))
        large = open_.where(F.col("m") > LEFT)
        held = held.where(F.col("m") > LEFT)
        level += 1
    values_of = found[0]
    for more in found[1:]:
        values_of = values_of.unionByName(more)
    met = wanted.join(values_of, ["_g", "k"], "left")
    named = [F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks]
    return met.groupBy("_g", *groups).agg(F.first("n").alias("n"), *named).drop("_g")


def _ranked(values: DataFrame, state: DataFrame, *on: str) -> DataFrame:
    """(_g, k, value) of ranks whose different values are few."""
    near = values.join(state, list(on))
    upto = F.sum("c").over(Window.partitionBy("_g", "k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("_upto", F.col("below") + upto).where("k <= _upto and k > _upto - c").select("_g", "k", F.col("_v").alias("value"))


def quantiles(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float], count: Column | None = None) -> DataFrame:
    """groups, n and exact quantiles, linear between the two nearest ranks; see ``order_statistics``."""
    at = lambda p: lambda n: (n - 1) * F.lit(float(p))
    ranks = {}
    for name, p in shares.items():
        ranks[f"_low_{name}"] = lambda n, p=p: F.floor(at(p)(n)) + 1
        ranks[f"_high_{name}"] = lambda n, p=p: F.ceil(at(p)(n)) + 1
    found = order_statistics(rows, groups, value, ranks, count)
    share = lambda p: at(p)(F.col("n")) - F.floor(at(p)(F.col("n")))
    return found.select(*groups, "n", *((F.col(f"_low_{x}") + share(p) * (F.col(f"_high_{x}") - F.col(f"_low_{x}"))).alias(x) for x, p in shares.items()))
