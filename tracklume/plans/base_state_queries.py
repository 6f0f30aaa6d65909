"""Base states over the hourly tracks: five recordings by user_id, the least user of each is its robot, and yaw is x as an angle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklume.operators import base_states as B
from tracklume.operators import tracks as K
from tracklume.plans.track_queries import HOUR, KEYS, PAIRS, TRACKS, segmented, tracks
from tracklume.sources.shared_tables import SharedTables

HISTORY, FUTURE, STRIDE, EXTENT = 8, 32, 3, 60.0
_WHERE = ["recording", "segment_id", "tick", HISTORY, FUTURE, STRIDE]


def _hourly(spark, sf_dir):
    found = K.resample(segmented(spark, sf_dir), KEYS, "t", ["x", "y"], HOUR)
    return found.withColumns({"recording": F.col("object_id") % 5, "yaw": K.wrap_angle(F.col("x"))})


def _robot_and_objects(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    robots = SharedTables(spark, "robots").write(rows.groupBy("recording").agg(F.min("object_id").alias("robot")), "robots")
    told = rows.join(robots, "recording")
    return told.where("object_id = robot"), told.where("object_id <> robot")


def presence_islands(spark, sf_dir):
    """The runs of days on which an object has events."""
    days = tracks(spark, sf_dir).select("object_id", F.floor(F.col("t") / 86400).alias("day"))
    return B.islands(days, ["object_id"], "day")


def base_state_objects(spark, sf_dir):
    """Every object of every base state: visible or known ahead, where it is, was at first, and will be."""
    found = B.base_states(*_robot_and_objects(spark, sf_dir), *_WHERE, EXTENT)
    first, now, last = F.col("past")[0], F.element_at("past", -1), F.element_at("coming", -1)
    places = {f"{p}_{c}": F.round(v[c], 6) for p, v in (("first", first), ("now", now), ("last", last)) for c in ("x", "y")}
    mean = F.round(F.aggregate("past", F.lit(0.0), lambda s, p: s + p["x"]) / HISTORY, 6)
    return found.select("recording", "tick", "object_id", "visible", "oracle", F.size("past").alias("n_past"), F.round(F.cos(now["yaw"]), 6).alias("cos_yaw"), mean.alias("mean_x"), *(v.alias(k) for k, v in places.items()))


def base_state_funnel(spark, sf_dir):
    robot, objects = _robot_and_objects(spark, sf_dir)
    attached = B.base_states(robot, objects, *_WHERE, EXTENT)
    return B.funnel(B.decisions(robot, *_WHERE), attached, "recording", "tick")


_HOURLY = PAIRS.format(dt="3600.0") + f""", hourly as (select object_id, object_id % 5 as recording, segment_id, tick, x + (tick * 3600.0 - t) / (t1 - t) * (x1 - x) as x, y + (tick * 3600.0 - t) / (t1 - t) * (y1 - y) as y from ticks),
 robots as (select recording, min(object_id) as robot from hourly group by recording),
 bounds as (select object_id, segment_id, min(tick) as a, max(tick) as b from hourly group by all),
 robot as (select h.*, row_number() over w as place, count(*) over (partition by h.recording) as size from hourly h join robots r on h.object_id = r.robot window w as (partition by h.recording order by h.tick)),
 made as (select r.recording, r.tick, r.x, r.y, r.tick - {HISTORY - 1} >= a and r.tick + {FUTURE} <= b as accepted from robot r join bounds using (object_id, segment_id)
   where place >= {HISTORY} and place + {FUTURE} <= size and (place - {HISTORY}) % {STRIDE} = 0),
 near as (select m.recording, m.tick, h.object_id, h.segment_id, m.tick + {FUTURE} <= b as oracle, m.x as rx, m.y as ry, h.x, h.y from made m
   join hourly h on h.recording = m.recording and h.tick = m.tick and h.object_id not in (select robot from robots) join bounds using (object_id, segment_id) where m.accepted and m.tick - {HISTORY - 1} >= a),
 placed as (select *, cos(rx) * (x - rx) + sin(rx) * (y - ry) as lx, cos(rx) * (y - ry) - sin(rx) * (x - rx) as ly from near),
 found as (select *, abs(lx) <= {EXTENT} and abs(ly) <= {EXTENT} as visible from placed where oracle or (abs(lx) <= {EXTENT} and abs(ly) <= {EXTENT}))"""
_LOCAL = {"x": "cos(rx) * ({h}.x - rx) + sin(rx) * ({h}.y - ry)", "y": "cos(rx) * ({h}.y - ry) - sin(rx) * ({h}.x - rx)"}

QUERIES = {f.__name__: f for f in (presence_islands, base_state_objects, base_state_funnel)}
ORACLE = {
    "presence_islands": f"""with {TRACKS}, days as (select distinct object_id, cast(floor(t / 86400) as bigint) as day from tracks),
 runs as (select *, day - row_number() over (partition by object_id order by day) as island from days)
select object_id, min(day) as first, max(day) as last, max(day) - min(day) + 1 as ticks from runs group by object_id, island""",
    "base_state_objects": f"""with {_HOURLY},
 means as (select f.recording, f.tick, f.object_id, avg({_LOCAL["x"].format(h="h")}) as mean_x from found f join hourly h on h.object_id = f.object_id and h.segment_id = f.segment_id and h.tick between f.tick - {HISTORY - 1} and f.tick group by all)
select f.recording, f.tick, f.object_id, visible, oracle, {HISTORY} as n_past, round(cos(f.x - rx), 6) as cos_yaw, round(mean_x, 6) as mean_x,
 round({_LOCAL["x"].format(h="p")}, 6) as first_x, round({_LOCAL["y"].format(h="p")}, 6) as first_y, round(lx, 6) as now_x, round(ly, 6) as now_y,
 case when oracle then round({_LOCAL["x"].format(h="n")}, 6) end as last_x, case when oracle then round({_LOCAL["y"].format(h="n")}, 6) end as last_y
from found f join means using (recording, tick, object_id) join hourly p on p.object_id = f.object_id and p.segment_id = f.segment_id and p.tick = f.tick - {HISTORY - 1}
 left join hourly n on n.object_id = f.object_id and n.segment_id = f.segment_id and n.tick = f.tick + {FUTURE}""",
    "base_state_funnel": f"""with {_HOURLY}, seen as (select distinct recording, tick from found where visible)
select recording, count(*) as candidates, count(*) filter (accepted) as accepted, count(*) filter (not accepted) as robot_gap, count(*) filter (accepted and seen.tick is null) as empty
from made left join seen using (recording, tick) group by recording""",
}
