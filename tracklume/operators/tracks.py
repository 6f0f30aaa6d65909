"""Operators over object tracks: rows of (object, t, x, y), ordered in time within an object or a segment of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a task orders at a time, about: a row of a day's gap becomes up to 25 ticks an hour apart.
TASK_ROWS = 20_000


def dealt(rows: DataFrame, keys: list[str], size: int = TASK_ROWS) -> DataFrame:
    """``rows`` by ``keys`` in parts of about ``size`` rows, where the session's shuffles have too few parts for that.

    Windows over ``keys``, and more columns beside them, then work in these
    parts, so what a task sorts doesn't grow with the table.  A key is never cut.
    """
    parts = -(-rows.count() // size)
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def resample(track: DataFrame, keys: list[str], t: str, values: list[str], dt: float, eps: float = 1e-9) -> DataFrame:
    """Linear interpolation of each segment (``keys``) on the global grid of multiples of ``dt``: keys, ``tick`` and values.

    Ticks run from ceil((start - eps) / dt) to floor((end + eps) / dt), both
    kept; a segment of fewer than two rows gives nothing.  Each row carries its
    next one and yields the ticks from its own time up to, and for the last
    pair including, the next time, so no range join is needed.
    """
    order = Window.partitionBy(*keys).orderBy(t)
    pair = track.withColumns({"_t1": F.lead(t).over(order), "_last": F.lead(t, 2).over(order).isNull(), **{f"_{v}1": F.lead(v).over(order) for v in values}}).where("_t1 is not null")
    first = F.ceil((F.col(t) - eps) / dt).cast("long")
    stop = F.when(F.col("_last"), F.floor((F.col("_t1") + eps) / dt)).otherwise(F.ceil((F.col("_t1") - eps) / dt) - 1).cast("long")
    ticks = pair.withColumns({"_a": first, "_b": stop}).where("_a <= _b").withColumn("tick", F.explode(F.sequence("_a", "_b")))
    share = (F.col("tick") * dt - F.col(t)) / (F.col("_t1") - F.col(t))
    return ticks.select(*keys, "tick", *((F.col(v) + share * (F.col(f"_{v}1") - F.col(v))).alias(v) for v in values))


def gradient(value: str, t: str, order: Window) -> Column:
    """Derivative by second-order differences on uneven times, one-sided at the ends, 0 for a single row."""
    f, f0, f1 = F.col(value), F.lag(value).over(order), F.lead(value).over(order)
    hs, hd = F.col(t) - F.lag(t).over(order), F.lead(t).over(order) - F.col(t)
    inner = (hs * hs * f1 + (hd * hd - hs * hs) * f - hd * hd * f0) / (hs * hd * (hd + hs))
    return F.when(hs.isNull() & hd.isNull(), 0.0).when(hs.isNull(), (f1 - f) / hd).when(hd.isNull(), (f - f0) / hs).otherwise(inner)


def kinematics(track: DataFrame, keys: list[str], t: str = "t", x: str = "x", y: str = "y") -> DataFrame:
    """Adds vx, vy, ax, ay, speed and accel; one shuffle and sort serve both derivatives."""
    order = Window.partitionBy(*keys).orderBy(t)
    first = track.withColumns({"vx": gradient(x, t, order), "vy": gradient(y, t, order)})
    second = first.withColumns({"ax": gradient("vx", t, order), "ay": gradient("vy", t, order)})
    return second.withColumns({"speed": F.hypot("vx", "vy"), "accel": F.hypot("ax", "ay")})


def wrap_angle(angle: Column) -> Column:
    """To [-pi, pi)."""
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def unwrap(track: DataFrame, keys: list[str], t: str, angle: str, out: str) -> DataFrame:
    """Adds ``out``: the angle with every step over half a turn turned back by whole turns."""
    order = Window.partitionBy(*keys).orderBy(t)
    step = F.col(angle) - F.lag(angle).over(order)
    turned = F.pmod(step + math.pi, F.lit(2 * math.pi)) - math.pi
    turned = F.when((turned == -math.pi) & (step > 0), F.lit(math.pi)).otherwise(turned)
    fixed = F.when(F.abs(step) < math.pi, 0.0).otherwise(F.coalesce(turned - step, F.lit(0.0)))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return track.withColumn("_fix", fixed).withColumn(out, F.col(angle) + F.sum("_fix").over(upto)).drop("_fix")


def row_windows(track: DataFrame, keys: list[str], t: str, before: int, after: int, stride: int) -> DataFrame:
    """Rows that are the current one of a window of ``before`` rows ahead of it and ``after`` behind, every ``stride`` rows of a segment.

    Adds ``place`` (from 0) and ``size`` (rows of the segment).
    """
    order = Window.partitionBy(*keys).orderBy(t)
    numbered = track.withColumns({"place": F.row_number().over(order) - 1, "size": F.count("*").over(Window.partitionBy(*keys))})
    return numbered.where((F.col("place") >= before) & (F.col("place") <= F.col("size") - 1 - after) & ((F.col("place") - before) % stride == 0))


def exact_tick_join(left: DataFrame, right: DataFrame, tick: str, tolerance: float) -> DataFrame:
    """Rows of both whose times differ by at most ``tolerance``: an equi-join on time cells, each left row sent to two neighbours, then the test."""
    width = 2 * tolerance
    near = F.floor((F.col(tick) + F.lit(tolerance)) / width)
    far = F.floor((F.col(tick) - F.lit(tolerance)) / width)
    spread = left.withColumn("_cell", F.explode(F.array_distinct(F.array(near, far))))
    other = right.withColumnRenamed(tick, "_tick").withColumn("_cell", F.floor(F.col("_tick") / width))
    return spread.join(other, "_cell").where(F.abs(F.col(tick) - F.col("_tick")) <= tolerance).drop("_cell").withColumnRenamed("_tick", f"{tick}_right")


def hidden_then_run(flags: Column, least: int) -> Column:
    """For an array of visibility: hidden first, and later a run of at least ``least`` visible frames."""
    text = F.array_join(F.transform(flags, lambda v: F.when(v, F.lit("1")).otherwise(F.lit("0"))), "")
    return text.startswith("0") & (F.instr(text, "1" * least) > 0)


def history_class(flags: Column, visible: int = 2, hidden: int = 2) -> Column:
    """``preferred``: the first half all visible and a later frame hidden; ``fallback``: enough of both, some visible before the last hidden; else ``none``."""
    half = F.floor(F.size(flags) / 2).cast("int")
    seen = F.size(F.filter(flags, lambda v: v))
    text = F.array_join(F.transform(flags, lambda v: F.when(v, F.lit("1")).otherwise(F.lit("0"))), "")
    preferred = ~F.substring(text, 1, half).contains("0") & F.substring(text, half + 1, F.size(flags)).contains("0")
    fallback = (seen >= visible) & (F.size(flags) - seen >= hidden) & text.rlike("1.*0")
    return F.when(preferred, "preferred").when(fallback, "fallback").otherwise("none")
