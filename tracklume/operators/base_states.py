"""Base states: decision ticks of a robot, with every object that was tracked without a break around them.

Ticks are whole numbers of a common grid.  A track is unbroken where its ticks
follow each other inside one segment: an island.  Each row of a track knows how
many ticks its island has before and behind it, so "8 history and 32 future
ticks in one segment" is a test of two numbers, and an object is attached by an
equi-join on (recording, tick): no range is joined, and no window is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklume.operators.tracks import wrap_angle
from tracklume.sources.shared_tables import SharedTables


def _island(keys: list[str], tick: str) -> Column:
    """The same number for the ticks of a run; repeated ticks are one."""
    return F.col(tick) - F.dense_rank().over(Window.partitionBy(*keys).orderBy(tick))


def islands(rows: DataFrame, keys: list[str], tick: str) -> DataFrame:
    """The runs of consecutive ticks of each key: keys, ``first``, ``last`` and ``ticks``; null ticks are left out."""
    marked = rows.where(F.col(tick).isNotNull()).withColumn("_island", _island(keys, tick))
    found = marked.groupBy(*keys, "_island").agg(F.min(tick).alias("first"), F.max(tick).alias("last"))
    return found.withColumn("ticks", F.col("last") - F.col("first") + 1).drop("_island")


def unbroken(rows: DataFrame, keys: list[str], tick: str) -> DataFrame:
    """``rows`` of non-null ticks with ``before`` and ``after``: how many ticks follow each other up to the row's and from it on, in its key."""
    marked = rows.where(F.col(tick).isNotNull()).withColumn("_island", _island(keys, tick))
    run = Window.partitionBy(*keys, "_island")
    return marked.withColumns({"before": F.col(tick) - F.min(tick).over(run), "after": F.max(tick).over(run) - F.col(tick)}).drop("_island")


def decisions(robot: DataFrame, recording: str, segment: str, tick: str, history: int, future: int, stride: int) -> DataFrame:
    """Every ``stride``-th robot row of a recording that has ``history`` - 1 rows before and ``future`` behind it, with ``accepted``: none of these lies in another segment or behind a gap."""
    order = Window.partitionBy(recording).orderBy(tick)
    placed = unbroken(robot, [recording, segment], tick).withColumns({"_place": F.row_number().over(order), "_size": F.count("*").over(Window.partitionBy(recording))})
    fits = (F.col("_place") >= history) & (F.col("_place") + future <= F.col("_size")) & ((F.col("_place") - history) % stride == 0)
    accepted = (F.col("before") >= history - 1) & (F.col("after") >= future)
    return placed.where(fits).withColumn("accepted", accepted).drop("_place", "_size", "before", "after")


def around(track: DataFrame, keys: list[str], tick: str, history: int, future: int) -> DataFrame:
    """``track`` (keys, tick, x, y, yaw) with ``before``, ``after`` and the poses of the ``history`` ticks up to a row and the ``future`` ones behind it; rows without a whole history go."""
    order = Window.partitionBy(*keys).orderBy(tick)
    pose = F.struct("x", "y", "yaw")
    past, coming = F.collect_list(pose).over(order.rowsBetween(1 - history, 0)), F.collect_list(pose).over(order.rowsBetween(1, future))
    known = unbroken(track, keys, tick).withColumns({"past": past, "coming": coming}).where(F.col("before") >= history - 1)
    return known.withColumn("coming", F.when(F.col("after") >= future, F.col("coming")))


def to_local(poses: Column, x: Column, y: Column, yaw: Column) -> Column:
    """An array of poses in the frame of one: x forward, y left."""
    c, s = F.cos(yaw), F.sin(yaw)

    def local(p: Column) -> Column:
        dx, dy = p["x"] - x, p["y"] - y
        return F.struct((c * dx + s * dy).alias("x"), (c * dy - s * dx).alias("y"), wrap_angle(p["yaw"] - yaw).alias("yaw"))

    return F.transform(poses, local)


def base_states(robot: DataFrame, objects: DataFrame, recording: str, segment: str, tick: str, history: int, future: int, stride: int, half_extent: float) -> DataFrame:
    """A row for each accepted decision and each object tracked over its history, in the robot's frame.

    ``robot`` has recording, segment, tick, x, y and yaw; ``objects`` object_id
    besides; (recording, object_id, tick) is unique.  Adds ``past`` (history
    poses), ``coming`` (future poses, null unless all are in the segment),
    ``visible`` (the object is inside the square of ``half_extent`` now) and
    ``oracle`` (its future is known); objects that are neither are left out,
    and a decision without any object has no row.  Null ticks attach nothing.
    """
    made = decisions(robot, recording, segment, tick, history, future, stride).where("accepted")
    at = SharedTables(robot.sparkSession, "base-states").write(made.select(recording, tick, *(F.col(c).alias(f"_{c}") for c in ("x", "y", "yaw")), F.lit(True).alias("_at")), "decisions")
    # Decisions are few, and go to the tracks: poses are gathered behind all exchanges, for decisions alone.
    met = objects.where(F.col(tick).isNotNull()).join(at, [recording, tick], "left")
    tracked = around(met, [recording, "object_id", segment], tick, history, future).where("_at")
    frame = F.col("_x"), F.col("_y"), F.col("_yaw")
    now = to_local(F.array(F.struct("x", "y", "yaw")), *frame)[0]
    inside = (F.abs(now["x"]) <= half_extent) & (F.abs(now["y"]) <= half_extent)
    found = tracked.withColumns({"visible": inside, "oracle": F.col("after") >= future}).where("visible or oracle")
    return found.select(recording, tick, "object_id", segment, "visible", "oracle", to_local(F.col("past"), *frame).alias("past"), to_local(F.col("coming"), *frame).alias("coming"))


def funnel(made: DataFrame, attached: DataFrame, recording: str, tick: str) -> DataFrame:
    """Of each recording: candidates, accepted, robot_gap, and ``empty``, accepted decisions that see no object."""
    seen = attached.where("visible").select(recording, tick).distinct().withColumn("_seen", F.lit(True))
    told = made.join(seen, [recording, tick], "left")
    count = lambda c: F.sum(c.cast("long"))
    return told.groupBy(recording).agg(F.count("*").alias("candidates"), count(F.col("accepted")).alias("accepted"), count(~F.col("accepted")).alias("robot_gap"), count(F.col("accepted") & F.col("_seen").isNull()).alias("empty"))
