"""Queries over ``events`` read as object tracks: object = user_id, t = epoch seconds, x = value, y = event_id % 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklume.operators import selection as S
from tracklume.operators import tracks as K
from tracklume.operators.segments import segments
from tracklume.sources.shared_tables import SharedTables
from tracklume.sources.tables import table

DAY, HOUR, TURN = 86400.0, 3600.0, 6.283185307179586
KEYS = ["object_id", "segment_id"]


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return events.select("event_id", F.col("user_id").alias("object_id"), seconds.alias("t"), F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), F.col("event_type").alias("kind"))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(K.dealt(tracks(spark, sf_dir), ["object_id"]), "object_id", "t", DAY)


#: The same views for DuckDB.
TRACKS = "tracks as (select event_id, user_id as object_id, epoch_us(ts) / 1e6 as t, value as x, cast(event_id % 100 as double) as y, event_type as kind from events)"
SEGMENTED = TRACKS + """, stepped as (select *, case when t - lag(t) over (partition by object_id order by t) > 86400.0 + 1e-9 then 1 else 0 end as fresh from tracks),
 segmented as (select * exclude (fresh), cast(sum(fresh) over (partition by object_id order by t rows unbounded preceding) as bigint) as segment_id from stepped)"""
GRADIENT = """case when hs is null and hd is null then 0.0 when hs is null then (f1 - f) / hd when hd is null then (f - f0) / hs
  else (hs * hs * f1 + (hd * hd - hs * hs) * f - hd * hd * f0) / (hs * hd * (hd + hs)) end"""


def track_segments(spark, sf_dir):
    return segmented(spark, sf_dir).select("event_id", "object_id", "t", "segment_id")


def segment_summary(spark, sf_dir):
    return segmented(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.round(F.avg("x"), 6).alias("mean_x"))


def track_resample_hourly(spark, sf_dir):
    found = K.resample(segmented(spark, sf_dir), KEYS, "t", ["x", "y"], HOUR)
    return found.select(*KEYS, "tick", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def track_gradient(spark, sf_dir):
    order = Window.partitionBy(*KEYS).orderBy("t")
    return segmented(spark, sf_dir).withColumn("vx", F.round(K.gradient("x", "t", order), 9)).select("event_id", "vx")


def kinematic_quantiles(spark, sf_dir):
    """Exact quantiles of speed, and the largest acceleration, of each kind of event."""
    moved = SharedTables(spark, "kinematics").write(K.kinematics(segmented(spark, sf_dir), KEYS).select("kind", "speed", "accel"), "moved")
    cuts = S.quantiles(moved, ["kind"], "speed", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    top = moved.groupBy("kind").agg(F.round(F.max("accel"), 9).alias("max_accel"))
    return cuts.join(top, "kind").select("kind", *(F.round(c, 9).alias(c) for c in ("p05", "p50", "p95")), "max_accel")


def yaw_unwrap(spark, sf_dir):
    turned = segmented(spark, sf_dir).withColumn("yaw", K.wrap_angle(F.col("x")))
    return K.unwrap(turned, KEYS, "t", "yaw", "heading").select("event_id", F.round("yaw", 6).alias("yaw"), F.round("heading", 6).alias("heading"))


def _windowed(spark, sf_dir):
    """Hourly positions of segments, with the step to each, and of the 40 rows from 7 before to 32 behind a row when they begin and end, their mean and how far they go."""
    order = Window.partitionBy(*KEYS).orderBy("tick")
    rows = K.resample(segmented(spark, sf_dir), KEYS, "t", ["x", "y"], HOUR)
    rows = rows.withColumn("step", F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)))
    around = order.rowsBetween(-7, 32)
    return rows.withColumns({"mean_x": F.avg("x").over(around), "first": F.min("tick").over(around), "last": F.max("tick").over(around), "path": F.sum("step").over(order.rowsBetween(-6, 32))})


def hopping_windows_8_32(spark, sf_dir):
    """Windows of 40 hours inside one segment, 7 before the current one and 32 behind, every five hours."""
    found = K.row_windows(_windowed(spark, sf_dir), KEYS, "tick", 7, 32, 5)
    return found.select(*KEYS, "tick", "first", "last", F.round("mean_x", 6).alias("mean_x"))


def window_funnel(spark, sf_dir):
    """What comes of the windows, every five hours of a segment: a segment under 40 hours is one short candidate, windows that move under 20 or over 30 a hour are too slow or too fast."""
    rows = _windowed(spark, sf_dir)
    speed = F.col("path") / 39
    verdict = F.when(speed < 20, "slow").when(speed > 30, "fast").otherwise("accepted")
    cut = K.row_windows(rows, KEYS, "tick", 7, 32, 5).select("object_id", verdict.alias("verdict"))
    short = rows.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n < 40").select("object_id", F.lit("short_segment").alias("verdict"))
    return cut.union(short).groupBy("verdict").agg(F.count("*").alias("candidates"), F.countDistinct("object_id").alias("objects"))


def rebase_first_row(spark, sf_dir):
    order = Window.partitionBy(*KEYS).orderBy("t")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = {c: F.first(c).over(whole) for c in ("t", "x", "y")}
    return segmented(spark, sf_dir).select("event_id", (F.col("t") - first["t"]).alias("dt"), F.round(F.col("x") - first["x"], 6).alias("dx"), F.round(F.col("y") - first["y"], 6).alias("dy"))


def exact_tick_join(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    left = rows.where("kind = 'click'").select(F.col("event_id").alias("left_id"), "t")
    right = rows.where("kind <> 'click'").select(F.col("event_id").alias("right_id"), "t")
    return K.exact_tick_join(left, right, "t", 30.0).select("left_id", "right_id")


def _eight(spark, sf_dir):
    order = Window.partitionBy("object_id").orderBy("t")
    flags = F.collect_list(F.col("x") > 50).over(order.rowsBetween(-7, 0))
    return tracks(spark, sf_dir).withColumn("flags", flags).where(F.size("flags") == 8)


def hidden_run_emergence(spark, sf_dir):
    return _eight(spark, sf_dir).select("event_id", K.hidden_then_run(F.col("flags"), 3).alias("emerges"))


def history_class(spark, sf_dir):
    return _eight(spark, sf_dir).select("event_id", K.history_class(F.col("flags")).alias("class"))


def bracket_lerp(spark, sf_dir):
    """As-of bracket join: each object's position at the query times noon of every day."""
    day = segmented(spark, sf_dir)
    found = K.resample(day, KEYS, "t", ["x"], DAY)
    return found.select("object_id", (F.col("tick") * DAY).alias("t"), F.round("x", 6).alias("x"))


_FLAGS = TRACKS + ", eight as (select event_id, string_agg(case when x > 50 then '1' else '0' end, '') over (partition by object_id order by t rows between 7 preceding and current row) as s from tracks)"
PAIRS = SEGMENTED + """, paired as (select object_id, segment_id, t, x, y, lead(t) over w as t1, lead(t, 2) over w is null as final, lead(x) over w as x1, lead(y) over w as y1
   from segmented window w as (partition by object_id, segment_id order by t)),
 spans as (select *, cast(ceil((t - 1e-9) / {dt}) as bigint) as a, cast(case when final then floor((t1 + 1e-9) / {dt}) else ceil((t1 - 1e-9) / {dt}) - 1 end as bigint) as b from paired where t1 is not null),
 ticks as (select *, unnest(generate_series(a, b)) as tick from spans where a <= b)"""
_WINDOWED = PAIRS.format(dt="3600.0") + """, hourly as (select object_id, segment_id, tick, x + (tick * 3600.0 - t) / (t1 - t) * (x1 - x) as x, y + (tick * 3600.0 - t) / (t1 - t) * (y1 - y) as y from ticks),
 stepped_ticks as (select *, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as step from hourly window w as (partition by object_id, segment_id order by tick)),
 placed as (select *, row_number() over w - 1 as place, count(*) over (partition by object_id, segment_id) as size, avg(x) over (w rows between 7 preceding and 32 following) as mean_x,
  min(tick) over (w rows between 7 preceding and 32 following) as first, max(tick) over (w rows between 7 preceding and 32 following) as last, sum(step) over (w rows between 6 preceding and 32 following) as path
  from stepped_ticks window w as (partition by object_id, segment_id order by tick))"""
_VELOCITY = SEGMENTED + """, v0 as (select *, lag(t) over w as tp, lead(t) over w as tn, lag(x) over w as xp, lead(x) over w as xn, lag(y) over w as yp, lead(y) over w as yn from segmented window w as (partition by object_id, segment_id order by t)),
 v1 as (select *, t - tp as hs, tn - t as hd from v0),
 v2 as (select *, {gx} as vx, {gy} as vy from v1),
 v3 as (select *, lag(vx) over w as vxp, lead(vx) over w as vxn, lag(vy) over w as vyp, lead(vy) over w as vyn from v2 window w as (partition by object_id, segment_id order by t)),
 v4 as (select *, {ax} as ax, {ay} as ay from v3)"""


def _gradient_sql(f: str, before: str, after: str) -> str:
    return GRADIENT.replace("f1", after).replace("f0", before).replace("- f)", f"- {f})").replace("(f -", f"({f} -").replace("* f -", f"* {f} -")


VELOCITY = _VELOCITY.format(gx=_gradient_sql("x", "xp", "xn"), gy=_gradient_sql("y", "yp", "yn"), ax=_gradient_sql("vx", "vxp", "vxn"), ay=_gradient_sql("vy", "vyp", "vyn"))

QUERIES = {f.__name__: f for f in (track_segments, segment_summary, track_resample_hourly, track_gradient, kinematic_quantiles, yaw_unwrap, hopping_windows_8_32, window_funnel, rebase_first_row, exact_tick_join, hidden_run_emergence, history_class, bracket_lerp)}
ORACLE = {
    "track_segments": f"with {SEGMENTED} select event_id, object_id, t, segment_id from segmented",
    "segment_summary": f"with {SEGMENTED} select object_id, segment_id, count(*) as n, min(t) as t0, max(t) as t1, round(avg(x), 6) as mean_x from segmented group by all",
    "track_resample_hourly": f"with {PAIRS.format(dt='3600.0')} select object_id, segment_id, tick, round(x + (tick * 3600.0 - t) / (t1 - t) * (x1 - x), 6) as x, round(y + (tick * 3600.0 - t) / (t1 - t) * (y1 - y), 6) as y from ticks",
    "bracket_lerp": f"with {PAIRS.format(dt='86400.0')} select object_id, tick * 86400.0 as t, round(x + (tick * 86400.0 - t) / (t1 - t) * (x1 - x), 6) as x from ticks",
    "track_gradient": f"with {VELOCITY} select event_id, round(vx, 9) as vx from v2",
    "kinematic_quantiles": f"with {VELOCITY} select kind, round(quantile_cont(sqrt(vx * vx + vy * vy), 0.05), 9) as p05, round(quantile_cont(sqrt(vx * vx + vy * vy), 0.5), 9) as p50, round(quantile_cont(sqrt(vx * vx + vy * vy), 0.95), 9) as p95, round(max(sqrt(ax * ax + ay * ay)), 9) as max_accel from v4 group by kind",
    "yaw_unwrap": f"""with {SEGMENTED}, yaws as (select *, x + pi() - 2 * pi() * floor((x + pi()) / (2 * pi())) - pi() as yaw from segmented),
 steps as (select *, yaw - lag(yaw) over (partition by object_id, segment_id order by t) as step from yaws),
 fixes as (select *, case when step is null or abs(step) < pi() then 0.0 else step + pi() - 2 * pi() * floor((step + pi()) / (2 * pi())) - pi() - step end as fix from steps)
select event_id, round(yaw, 6) as yaw, round(yaw + sum(fix) over (partition by object_id, segment_id order by t rows unbounded preceding), 6) as heading from fixes""",
    "hopping_windows_8_32": f"""with {_WINDOWED}
select object_id, segment_id, tick, first, last, round(mean_x, 6) as mean_x from placed where place >= 7 and place <= size - 33 and (place - 7) % 5 = 0""",
    "window_funnel": f"""with {_WINDOWED}, verdicts as (select object_id, case when path / 39 < 20 then 'slow' when path / 39 > 30 then 'fast' else 'accepted' end as verdict from placed where place >= 7 and place <= size - 33 and (place - 7) % 5 = 0
  union all select object_id, 'short_segment' from hourly group by object_id, segment_id having count(*) < 40)
select verdict, count(*) as candidates, count(distinct object_id) as objects from verdicts group by verdict""",
    "rebase_first_row": f"with {SEGMENTED} select event_id, t - first(t) over w as dt, round(x - first(x) over w, 6) as dx, round(y - first(y) over w, 6) as dy from segmented window w as (partition by object_id, segment_id order by t)",
    "exact_tick_join": f"with {TRACKS} select a.event_id as left_id, b.event_id as right_id from tracks a join tracks b on a.kind = 'click' and b.kind <> 'click' and abs(a.t - b.t) <= 30.0",
    "hidden_run_emergence": f"with {_FLAGS} select event_id, s like '0%' and contains(s, '111') as emerges from eight where length(s) = 8",
    "history_class": f"""with {_FLAGS} select event_id, case when left(s, 4) = '1111' and contains(right(s, 4), '0') then 'preferred'
  when length(replace(s, '0', '')) >= 2 and length(replace(s, '1', '')) >= 2 and regexp_matches(s, '1.*0') then 'fallback' else 'none' end as class from eight where length(s) = 8""",
}
