"""Rectangles near each other, their rasters, and contacts of moving footprints: events as poses, and the hourly tracks of recordings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklume.functions.footprints import Shape, with_clearance
from tracklume.operators import contacts as C
from tracklume.operators import grids as B
from tracklume.operators import tracks as K
from tracklume.plans.geometry_queries import POINTS, RESOLUTION, SIDE, gathered, points
from tracklume.plans.track_queries import HOUR, KEYS, PAIRS, segmented
from tracklume.sources.shared_tables import SharedTables

REACH, TILE = 2.0, 4.0
BIG, SMALL, ROBOT, OBJECT = (2.0, 1.0, 0.0), (1.2, 0.8, 0.0), (1.2, 0.8, 0.0), (0.0, 0.0, 0.3)


def _posed(rows, prefix):
    return rows.select("hour", F.col("event_id").alias(prefix), *(F.col(c).alias(f"{prefix}{c}") for c in ("x", "y", "yaw")))


def _poses(rows, prefix):
    """The different poses of an hour with their events, and the cosine and sine of their yaw."""
    yaw = F.col(f"{prefix}yaw")
    return gathered(_posed(rows, prefix), prefix).withColumns({f"{prefix}cos": F.cos(yaw), f"{prefix}sin": F.sin(yaw)})


def near_rectangles(spark, sf_dir):
    """Purchases as large rectangles and the other events of their hour as small ones, where they are within two metres: their clearance.

    Only poses are moved, with their events.  Clearances are worked out once
    for two poses as these meet in a tile, and events come from their poses.
    """
    p = points(spark, sf_dir)
    a, b = (replace(Shape.named(x, *size), turn=(F.col(f"{x}cos"), F.col(f"{x}sin"))) for x, size in (("a", BIG), ("b", SMALL)))
    box = C.grown(a.box(), REACH + b.reach())
    met = C.box_join(_poses(p.where("kind = 'purchase'"), "a"), _poses(p.where("kind <> 'purchase'"), "b").hint("merge"), ["hour"], box, F.col("bx"), F.col("by"), TILE)
    # Poses too far apart have no event: a filter of clearances would work them out once more.
    told = with_clearance(met, a, b, "c").select(F.when(F.col("c") <= REACH, F.col("as")).alias("as"), "bs", F.round("c", 6).alias("clearance"), (F.col("c") <= 1e-9).alias("contact"))
    first = told.select("bs", "clearance", "contact", F.inline_outer("as")).where("a is not null")
    return first.select("a", "clearance", "contact", F.inline("bs")).select("a", "b", "clearance", "contact")


def rectangle_rasters(spark, sf_dir):
    """The cells that each purchase's rectangle touches."""
    p = _posed(points(spark, sf_dir).where("kind = 'purchase'"), "a")
    return C.touched_cells(p, ["a"], Shape.named("a", *BIG), RESOLUTION, SIDE, SIDE)


def _hourly(spark, sf_dir):
    """Hourly poses with the next one in the segment: x and y in metres, yaw turns with x."""
    rows = K.resample(segmented(spark, sf_dir), KEYS, "t", ["x", "y"], HOUR).withColumn("recording", F.col("object_id") % 5)
    posed = rows.select("recording", *KEYS, "tick", (F.col("x") / 10 - 5).alias("x0"), (F.col("y") / 10 - 5).alias("y0"), K.wrap_angle(F.col("x") / 20).alias("yaw0"))
    order = Window.partitionBy(*KEYS).orderBy("tick")
    return posed.withColumns({f"{c}1": F.lead(f"{c}0").over(order) for c in ("x", "y", "yaw")}).where("x1 is not null")


def _way(rows, prefix, size):
    """``rows`` with their pose columns named by ``prefix``, and the shapes at both ends."""
    renamed = rows.withColumnsRenamed({f"{c}{i}": f"{prefix}{i}{c}" for c in ("x", "y", "yaw") for i in "01"})
    return renamed, tuple(Shape.named(f"{prefix}{i}", *size) for i in "01")


def _robots(spark, rows, name):
    """A recording's first object as ``name``; written, as Spark then knows how few rows these are and deals the others by nothing."""
    return SharedTables(spark, "robots").write(rows.groupBy("recording").agg(F.min("object_id").alias(name)), "first")


def moving_contacts(spark, sf_dir):
    """A recording's first object as a rectangle and the others as discs, hour by hour: whether they touch on the way, and when first."""
    rows = _hourly(spark, sf_dir)
    told = rows.join(_robots(spark, rows, "robot"), "recording")
    left, a = _way(told.where("object_id = robot").drop("object_id", "segment_id", "robot"), "a", ROBOT)
    right, b = _way(told.where("object_id <> robot").drop("segment_id", "robot"), "b", OBJECT)
    # The right point is the middle of its way; the left box is grown by half of the longest step that matters here.
    right = right.withColumns({"mx": (F.col("b0x") + F.col("b1x")) / 2, "my": (F.col("b0y") + F.col("b1y")) / 2}).withColumn("half", F.hypot(F.col("b1x") - F.col("b0x"), F.col("b1y") - F.col("b0y")) / 2 + b[0].reach())
    # Written, so that the robots' ways go to the others' where they are small, and these aren't dealt by hours.
    left = SharedTables(spark, "robots").write(left, "ways")
    slow, fast = right.where(F.col("half") <= TILE), right.where(F.col("half") > TILE)
    box = C.swept_box(*a)
    near = C.box_join(left, slow, ["recording", "tick"], C.grown(box, TILE), F.col("mx"), F.col("my"), TILE).where(_overlap(box, C.swept_box(*b)))
    far = left.join(fast, ["recording", "tick"]).where(_overlap(box, C.swept_box(*b)))
    found = C.contacts(near.unionByName(far), ["recording", "tick", "object_id"], a, b)
    return found.select("recording", "tick", "object_id", "contact", "sure", F.round("after", 6).alias("after"), F.round("upto", 6).alias("upto"), F.round("least", 6).alias("least"))


def _overlap(a, b):
    return (a[0] <= b[1]) & (b[0] <= a[1]) & (a[2] <= b[3]) & (b[2] <= a[3])


def sweep_occupancy(spark, sf_dir):
    """How many cells that purchases of the recording occupy each hour's sweep of the robot touches, and the first of them it meets."""
    rows = _hourly(spark, sf_dir)
    left, a = _way(rows.join(_robots(spark, rows, "object_id"), ["recording", "object_id"]).drop("object_id", "segment_id"), "a", ROBOT)
    seen = points(spark, sf_dir).where("kind = 'purchase'").withColumn("recording", F.col("object_id") % 5)
    cells = B.cells(seen, "x", "y", RESOLUTION, SIDE, SIDE).select("recording", "row", "col").distinct()
    cell = C.cell_shape(F.col("row"), F.col("col"), RESOLUTION, SIDE, SIDE)
    met = C.box_join(left, cells, ["recording"], C.grown(C.swept_box(*a), RESOLUTION), cell.x, cell.y, TILE)
    found = C.contacts(met, ["recording", "tick", "row", "col"], a, (cell, cell)).where("contact")
    first = F.min(F.struct(F.round("upto", 9).alias("u"), (F.col("row") * SIDE + F.col("col")).alias("c")))
    return found.groupBy("recording", "tick").agg(F.count("*").alias("cells"), first.alias("f")).select("recording", "tick", "cells", F.round("f.u", 6).alias("first"), F.col("f.c").alias("first_cell"))


def _outside_sql(px, py, of, length, width):
    lx = f"(({px}) - {of}x) * cos({of}yaw) + (({py}) - {of}y) * sin({of}yaw)"
    ly = f"(({py}) - {of}y) * cos({of}yaw) - (({px}) - {of}x) * sin({of}yaw)"
    return f"sqrt(greatest(abs({lx}) - {length / 2}, 0.0) ** 2 + greatest(abs({ly}) - {width / 2}, 0.0) ** 2)"


def _corners_sql(of, length, width):
    for i, j in ((1, 1), (-1, 1), (-1, -1), (1, -1)):
        dx, dy = i * length / 2, j * width / 2
        yield f"{of}x + ({dx}) * cos({of}yaw) - ({dy}) * sin({of}yaw)", f"{of}y + ({dx}) * sin({of}yaw) + ({dy}) * cos({of}yaw)"


def _gaps_sql(a, b, la, wa, lb, wb):
    lx, ly = f"({b}x - {a}x) * cos({a}yaw) + ({b}y - {a}y) * sin({a}yaw)", f"({b}y - {a}y) * cos({a}yaw) - ({b}x - {a}x) * sin({a}yaw)"
    c, s = f"abs(cos({b}yaw - {a}yaw))", f"abs(sin({b}yaw - {a}yaw))"
    return [f"abs({lx}) - ({la} + {lb} * {c} + {wb} * {s}) / 2", f"abs({ly}) - ({wa} + {lb} * {s} + {wb} * {c}) / 2"]


def clearance_sql(a, sa, b, sb):
    """The clearance of two shapes of poses ``a``x, ``a``y, ``a``yaw and sizes (length, width, radius)."""
    gaps = f"greatest({', '.join([*_gaps_sql(a, b, *sa[:2], *sb[:2]), *_gaps_sql(b, a, *sb[:2], *sa[:2])])})"
    near = [_outside_sql(x, y, b, *sb[:2]) for x, y in _corners_sql(a, *sa[:2])] + [_outside_sql(x, y, a, *sa[:2]) for x, y in _corners_sql(b, *sb[:2])]
    return f"(case when {gaps} > 0 then least({', '.join(near)}) else {gaps} end - {sa[2] + sb[2]})"


def _wrap_sql(v):
    return f"(({v}) + pi() - 2 * pi() * floor((({v}) + pi()) / (2 * pi())) - pi())"


def _contacts_sql(ways, keys, sa, sb, depth=12):
    """CTEs ``front`` and ``found`` over a CTE ``ways`` of the columns a0x, ..., b1yaw."""
    poses = [f"{p}{i}{c}" for p in "ab" for i in "01" for c in ("x", "y", "yaw")]
    names = ", ".join([*keys, *poses])
    move = " + ".join(f"sqrt(({p}1x - {p}0x) ** 2 + ({p}1y - {p}0y) ** 2) + {(s[0] ** 2 + s[1] ** 2) ** 0.5 / 2} * abs({_wrap_sql(f'{p}1yaw - {p}0yaw')})" for p, s in (("a", sa), ("b", sb)))
    at = ", ".join(f"{p}0x + mid * ({p}1x - {p}0x) as {p}mx, {p}0y + mid * ({p}1y - {p}0y) as {p}my, {p}0yaw + mid * {_wrap_sql(f'{p}1yaw - {p}0yaw')} as {p}myaw" for p in "ab")
    return f"""{ways},
 ends as (select *, {clearance_sql('a0', sa, 'b0', sb)} as clo, {clearance_sql('a1', sa, 'b1', sb)} as chi, {move} as move from ways),
 front as (select {names}, move, 0.0::double as lo, 1.0::double as hi, clo, chi, 0 as level from ends
  union all select {names}, move, case side when 0 then lo else mid end, case side when 0 then mid else hi end, case side when 0 then clo else cmid end, case side when 0 then cmid else chi end, level + 1
  from (select *, {clearance_sql('am', sa, 'bm', sb)} as cmid from (select *, {at} from (select *, (lo + hi) / 2 as mid, min(case when clo <= 0 or chi <= 0 then hi end) over (partition by {', '.join(keys)}) as known from front)
   where clo > 0 and chi > 0 and clo + chi <= move * (hi - lo) and (known is null or lo < known) and level < {depth})), (values (0), (1)) sides(side)),
 hits as (select *, case when clo <= 0 then lo else hi end as upto, clo <= 0 or chi <= 0 as sure from front where clo <= 0 or chi <= 0 or (level = {depth} and clo + chi <= move * (hi - lo))),
 firsts as (select *, row_number() over (partition by {', '.join(keys)} order by upto, lo, sure) as place from hits),
 leasts as (select {', '.join(keys)}, min(least(clo, chi)) as least from front group by all),
 found as (select l.*, f.upto is not null as contact, f.sure, f.lo as after, f.upto from leasts l left join firsts f on {' and '.join(f'l.{k} = f.{k}' for k in keys)} and f.place = 1)"""


_HOURLY = PAIRS.format(dt="3600.0") + f""", hourly as (select object_id % 5 as recording, object_id, segment_id, tick, (x + (tick * 3600.0 - t) / (t1 - t) * (x1 - x)) as x, (y + (tick * 3600.0 - t) / (t1 - t) * (y1 - y)) as y from ticks),
 posed as (select recording, object_id, segment_id, tick, x / 10 - 5 as x0, y / 10 - 5 as y0, {_wrap_sql("x / 20")} as yaw0 from hourly),
 steps as (select *, lead(x0) over w as x1, lead(y0) over w as y1, lead(yaw0) over w as yaw1 from posed window w as (partition by object_id, segment_id order by tick)),
 moved as (select * from steps where x1 is not null), robots as (select recording, min(object_id) as robot from moved group by recording)"""
_A = "a.x0 as a0x, a.y0 as a0y, a.yaw0 as a0yaw, a.x1 as a1x, a.y1 as a1y, a.yaw1 as a1yaw"
_RA = (ROBOT[0] ** 2 + ROBOT[1] ** 2) ** 0.5 / 2
_SWEPT = f"least(a.x0, a.x1) - {_RA} <= greatest(b.x0, b.x1) + 0.3 and least(b.x0, b.x1) - 0.3 <= greatest(a.x0, a.x1) + {_RA} and least(a.y0, a.y1) - {_RA} <= greatest(b.y0, b.y1) + 0.3 and least(b.y0, b.y1) - 0.3 <= greatest(a.y0, a.y1) + {_RA}"
_MOVING = f"ways as (select a.recording, a.tick, b.object_id, {_A}, {_A.replace('a.', 'b.').replace(' as a', ' as b')} from robots r join moved a on a.object_id = r.robot join moved b on b.recording = a.recording and b.tick = a.tick and b.object_id <> r.robot where {_SWEPT})"
_CELL = f"(c.col + 0.5 - {SIDE / 2}) * {RESOLUTION}", f"(c.row + 0.5 - {SIDE / 2}) * {RESOLUTION}"
_AT_CELL = ", ".join(f"{_CELL[0]} as b{i}x, {_CELL[1]} as b{i}y, 0.0 as b{i}yaw" for i in "01")
_OCCUPIED = f"""points as (select user_id % 5 as recording, value / 10 - 5 as x, event_id % 100 / 10.0 - 5 as y from events where event_type = 'purchase'),
 cells as (select distinct recording, cast(floor(y / {RESOLUTION} + {SIDE / 2}) as int) as row, cast(floor(x / {RESOLUTION} + {SIDE / 2}) as int) as col from points),
 ways as (select a.recording, a.tick, c.row, c.col, {_A}, {_AT_CELL} from robots r join moved a on a.object_id = r.robot join cells c on c.recording = a.recording and c.row between 0 and {SIDE - 1} and c.col between 0 and {SIDE - 1}
  and {_CELL[0]} between least(a.x0, a.x1) - {_RA} - {RESOLUTION} and greatest(a.x0, a.x1) + {_RA} + {RESOLUTION} and {_CELL[1]} between least(a.y0, a.y1) - {_RA} - {RESOLUTION} and greatest(a.y0, a.y1) + {_RA} + {RESOLUTION})"""
_SQUARE = (RESOLUTION, RESOLUTION, 0.0)
_NEAR = POINTS + ", near as (select a.event_id as a, b.event_id as b, a.x as ax, a.y as ay, a.yaw as ayaw, b.x as qx, b.y as qy, b.yaw as qyaw from points a join points b on a.hour = b.hour and a.kind = 'purchase' and b.kind <> 'purchase')"
_REACH = f"{BIG[0] / 2} * abs(cos(yaw)) + {BIG[1] / 2} * abs(sin(yaw))", f"{BIG[0] / 2} * abs(sin(yaw)) + {BIG[1] / 2} * abs(cos(yaw))"
_TURNED = f"{RESOLUTION / 2} * (abs(cos(yaw)) + abs(sin(yaw)))"

QUERIES = {f.__name__: f for f in (near_rectangles, rectangle_rasters, moving_contacts, sweep_occupancy)}
ORACLE = {
    "near_rectangles": f"with {_NEAR}, c as (select a, b, {clearance_sql('a', BIG, 'q', SMALL)} as c from near) select a, b, round(c, 6) as clearance, c <= 1e-9 as contact from c where c <= {REACH}",
    "rectangle_rasters": f"""with {POINTS}, cells as (select event_id, x, y, yaw, r as row, c as col, (c + 0.5 - {SIDE / 2}) * {RESOLUTION} - x as dx, (r + 0.5 - {SIDE / 2}) * {RESOLUTION} - y as dy
  from points, generate_series(0, {SIDE - 1}) a(r), generate_series(0, {SIDE - 1}) b(c) where kind = 'purchase')
select event_id as a, cast(row as int) as row, cast(col as int) as col from cells where abs(dx) <= {_REACH[0]} + {RESOLUTION / 2} + 1e-12 and abs(dy) <= {_REACH[1]} + {RESOLUTION / 2} + 1e-12
 and abs(dx * cos(yaw) + dy * sin(yaw)) <= {BIG[0] / 2} + {_TURNED} + 1e-12 and abs(dy * cos(yaw) - dx * sin(yaw)) <= {BIG[1] / 2} + {_TURNED} + 1e-12""",
    "moving_contacts": f"with recursive {_contacts_sql(f'{_HOURLY}, {_MOVING}', ['recording', 'tick', 'object_id'], ROBOT, OBJECT)} select recording, tick, object_id, contact, sure, round(after, 6) as after, round(upto, 6) as upto, round(least, 6) as least from found",
    "sweep_occupancy": f"""with recursive {_contacts_sql(f'{_HOURLY}, {_OCCUPIED}', ['recording', 'tick', 'row', 'col'], ROBOT, _SQUARE)}, placed as (select *, row_number() over (partition by recording, tick order by round(upto, 9), row * {SIDE} + col) as place from found where contact)
select recording, tick, count(*) as cells, round(min(upto), 6) as first, max(case when place = 1 then row * {SIDE} + col end) as first_cell from placed group by recording, tick""",
}
