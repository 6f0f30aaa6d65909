"""Headings of resampled tracks: from measured angles where a segment has any, else from motion, else zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklume.operators.tracks import unwrap

#: Slower rows have no direction of their own.
STILL = 1e-6


def interpolated(rows: DataFrame, keys: list[str], t: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: ``value`` where it is there, between its neighbours in time elsewhere, and the nearest one beyond the ends; null where a key has none.

    The next value is the last one in descending order: both windows are running ones.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    upto = lambda way: Window.partitionBy(*keys).orderBy(way(t)).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("_known", known).withColumn("_before", F.last("_known", True).over(upto(F.asc))).withColumn("_after", F.last("_known", True).over(upto(F.desc)))
    a, b = F.col("_before"), F.col("_after")
    share = (F.col(t) - a["t"]) / (b["t"] - a["t"])
    between = F.when(a.isNull(), b["v"]).when(b.isNull() | (b["t"] == a["t"]), a["v"]).otherwise(a["v"] + share * (b["v"] - a["v"]))
    return held.withColumn(out, between).drop("_known", "_before", "_after")


def motion_heading(rows: DataFrame, keys: list[str], t: str, vx: str, vy: str) -> DataFrame:
    """Adds ``heading``: the unwrapped direction of the velocity; rows that stand still take it between those that move; null where none of a key moves."""
    moving = F.hypot(vx, vy) > STILL
    angled = rows.withColumn("_moving", F.coalesce(moving, F.lit(False))).withColumn("_angle", F.atan2(vy, vx))
    whole = unwrap(angled, [*keys, "_moving"], t, "_angle", "_turned").withColumn("_turned", F.when(F.col("_moving"), F.col("_turned")))
    return interpolated(whole, keys, t, "_turned", "heading").drop("_moving", "_angle", "_turned")


def oriented(samples: DataFrame, measured: DataFrame, keys: list[str], t: str, yaw: str, vx: str, vy: str) -> DataFrame:
    """``samples`` (keys, t, vx, vy) with ``yaw`` and ``source``.

    A segment of which ``measured`` (keys, t, yaw) has an angle, null and NaN
    ones left out, takes these, unwrapped, between them and held at the ends
    (``measured``); else its motion's heading (``motion``); else 0 (``zero``).
    Columns named yaw or source are replaced.
    """
    angles = unwrap(measured.where(F.col(yaw).isNotNull() & ~F.isnan(yaw)).select(*keys, t, yaw), keys, t, yaw, "_yaw")
    own = samples.drop("yaw", "source")
    names = own.columns
    both = own.withColumns({"_yaw": F.lit(None).cast("double"), "_sample": F.lit(True)}).unionByName(angles.select(*keys, t, "_yaw").withColumn("_sample", F.lit(False)), allowMissingColumns=True)
    told = interpolated(both, keys, t, "_yaw", "_measured").where("_sample")
    moved = motion_heading(told, keys, t, vx, vy)
    source = F.when(F.col("_measured").isNotNull(), "measured").when(F.col("heading").isNotNull(), "motion").otherwise("zero")
    return moved.select(*names, F.coalesce("_measured", "heading", F.lit(0.0)).alias("yaw"), source.alias("source"))


def sources(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key: rows by source, and ``orientation``: their one source, or ``mixed``."""
    count = lambda s: F.sum((F.col("source") == s).cast("long")).alias(s)
    one = F.when(F.count_distinct("source") == 1, F.min("source")).otherwise("mixed")
    return rows.groupBy(*keys).agg(*(count(s) for s in ("measured", "motion", "zero")), one.alias("orientation"))


def time_violations(rows: DataFrame, keys: list[str], segment: str, t: str, dt: float | Column, tolerance: float = 1e-9) -> DataFrame:
    """``rule``, keys and ``n``: steps that break a track: ``not_increasing`` times of a key, ``uneven_step`` inside a segment, ``segment_returns`` to one that was left; ``unknown_time`` for nulls."""
    order = Window.partitionBy(*keys).orderBy(t, segment)
    step, same = F.col(t) - F.lag(t).over(order), F.lag(segment).over(order) == F.col(segment)
    marked = rows.withColumns({"_step": step, "_same": same, "_back": F.lag(segment).over(order) > F.col(segment)})
    rules = {"unknown_time": F.col(t).isNull(), "not_increasing": F.col("_step") <= 0, "uneven_step": F.col("_same") & (F.abs(F.col("_step") - dt) > tolerance), "segment_returns": F.col("_back")}
    broken = F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items()))))
    return marked.withColumn("rule", broken).groupBy("rule", *keys).agg(F.count("*").alias("n"))


def sum_violations(rows: DataFrame, keys: list[str], value: str, wanted: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """``rule`` (sum_off, negative or unknown), keys and ``n`` of the groups whose values don't add up to ``wanted``."""
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("_s"), F.min(value).alias("_m"), F.count("*").alias("n"), F.count(value).alias("_k"))
    rules = {"unknown": F.col("_k") < F.col("n"), "negative": F.col("_m") < 0, "sum_off": F.abs(F.col("_s") - wanted) > tolerance}
    return sums.withColumn("rule", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items()))))).select("rule", *keys, "n")
