"""Headings with their sources, whole-table contracts, complete joins, revalued labels, variants and slices over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklume.operators import headings as H
from tracklume.operators import strict as T
from tracklume.operators import tracks as K
from tracklume.plans.track_queries import GRADIENT, HOUR, KEYS, PAIRS, SEGMENTED, segmented
from tracklume.sources.tables import table


def _oriented(spark, sf_dir):
    """Hourly ticks of segments, with velocities; angles were measured at three events of four, but for every third object."""
    rows = segmented(spark, sf_dir)
    order = Window.partitionBy(*KEYS).orderBy("t")
    ticks = K.resample(rows, KEYS, "t", ["x", "y"], HOUR).withColumn("t", F.col("tick") * HOUR)
    moved = ticks.withColumns({f"v{c}": K.gradient(c, "t", order) for c in "xy"})
    known = (F.col("object_id") % 3 != 0) & (F.col("event_id") % 4 != 0)
    measured = rows.select(*KEYS, "t", F.when(known, K.wrap_angle(F.col("x"))).alias("yaw"))
    return H.oriented(moved, measured, KEYS, "t", "yaw", "vx", "vy")


def object_orientation(spark, sf_dir):
    """The heading of every hourly tick, as a direction, and where it comes from."""
    return _oriented(spark, sf_dir).select(*KEYS, "tick", "source", F.round(F.cos("yaw"), 5).alias("cos_yaw"), F.round(F.sin("yaw"), 5).alias("sin_yaw"))


def orientation_sources(spark, sf_dir):
    return H.sources(_oriented(spark, sf_dir), ["object_id"])


def time_contract(spark, sf_dir):
    """What breaks the contract of a track of hourly steps in the raw events, by rule."""
    found = H.time_violations(segmented(spark, sf_dir), ["object_id"], "segment_id", "t", HOUR)
    return found.groupBy("rule").agg(F.count("*").alias("objects"), F.sum("n").alias("n"))


def sum_contract(spark, sf_dir):
    """Orders whose line items' discounts don't add up to a fifth, or hold a negative share of the mean."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") - 0.01).alias("share"))
    return H.sum_violations(rows, ["l_orderkey"], "share", 0.2, 1e-9)


def _parts(spark, sf_dir):
    """Orders, their line items and their customers' segments, by order; some of each are left out."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0")
    items = table(spark, sf_dir, "lineitem").where("l_orderkey % 13 <> 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    urgent = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_orderkey % 17 <> 0").select(F.col("l_orderkey").alias("k"), F.lit(1).alias("first"))
    return {"events": o.select(F.col("o_orderkey").alias("k"), "o_totalprice"), "trajectories": items, "targets": urgent}


def complete_events(spark, sf_dir):
    """How many orders are complete over three tables, and what the others lack or have too often."""
    joined = T.complete_join(_parts(spark, sf_dir), ["k"])
    return joined.groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum("events.o_totalprice"), 2).alias("price"), F.sum("trajectories.n").alias("items"))


def complete_rows(spark, sf_dir):
    """The joined rows of complete orders."""
    joined = T.complete_join(_parts(spark, sf_dir), ["k"]).where("state = 'complete'")
    return T.require_complete(joined, ["k"]).select("k", F.col("events.o_totalprice").alias("price"), F.col("trajectories.n").alias("n"), F.col("trajectories.quantity").alias("quantity"))


def revalued_labels(spark, sf_dir):
    """Labels of documents, overwritten by records of every third; which changed, and what they were."""
    labels = table(spark, sf_dir, "labels")
    records = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return T.revalued(labels, records, ["doc_id"], ["quality", "toxic"]).select("doc_id", "quality", "toxic", "revalued", F.array_join("was", ",").alias("was"))


def sidecar_rows(spark, sf_dir):
    """Documents with their labels' sidecar, one to one: the joined rows of languages, and by state what doesn't join."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return T.complete_join({"document": docs, "label": labels}, ["doc_id"]).select("doc_id", "state", F.col("document.lang").alias("lang"), F.col("label.quality").alias("quality"), F.col("label.toxic").alias("toxic"))


def footprint_variants(spark, sf_dir):
    """Parts as footprints, to canonical JSON and back; sizes of zero and unknown kinds have none."""
    size = F.col("p_size")
    kind = F.when(size % 5 == 0, "hexagon").when(size % 2 == 0, "circle").otherwise("rectangle")
    fields = {"radius_m": (size % 4) / 2, "length_m": size / 4, "width_m": (size % 7) / 2}
    told = table(spark, sf_dir, "part").select("p_partkey", T.footprint_json(kind, fields).alias("spec"))
    back = T.footprint_struct(F.col("spec"))
    return told.select("p_partkey", "spec", *(back[f].alias(f) for f in ("kind", "radius_m", "length_m", "width_m")))


def provenance_slices(spark, sf_dir):
    """Events by slices of their JSON provenance, some of which have no such key."""
    rows = table(spark, sf_dir, "events").select("value", "event_type", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"source": {"kind": "'), "event_type", F.lit('"}}'))).otherwise(F.col("props")).alias("p"))
    told = T.allowed(rows.withColumns({"kind": T.slice_key(F.col("p"), "$.source.kind"), "rest": T.slice_key(F.col("p"), "$.source.rest")}), ["kind", "rest", "value"])
    return told.groupBy("kind", "rest").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_LERP = "case when t0 is null then u1 when t1 is null or t1 = t0 then u0 else u0 + (t - t0) / (t1 - t0) * (u1 - u0) end"
_ORIENTED = PAIRS.format(dt="3600.0") + f""", hourly as (select object_id, segment_id, tick, tick * 3600.0 as t, x + (tick * 3600.0 - t) / (t1 - t) * (x1 - x) as x, y + (tick * 3600.0 - t) / (t1 - t) * (y1 - y) as y from ticks),
 near as (select *, t - lag(t) over w as hs, lead(t) over w - t as hd, lag(x) over w as xp, lead(x) over w as xn, lag(y) over w as yp, lead(y) over w as yn from hourly window w as (partition by object_id, segment_id order by t)),
 moved as (select *, {GRADIENT.replace("f1", "xn").replace("f0", "xp").replace("- f)", "- x)").replace("(f -", "(x -").replace("* f -", "* x -")} as vx, {GRADIENT.replace("f1", "yn").replace("f0", "yp").replace("- f)", "- y)").replace("(f -", "(y -").replace("* f -", "* y -")} as vy from near),
 angles as (select object_id, segment_id, t, x + pi() - 2 * pi() * floor((x + pi()) / (2 * pi())) - pi() as a, true as measured from segmented where object_id % 3 <> 0 and event_id % 4 <> 0
  union all select object_id, segment_id, t, atan2(vy, vx), false from moved where sqrt(vx * vx + vy * vy) > 1e-6),
 stepped_a as (select *, a - lag(a) over (partition by object_id, segment_id, measured order by t) as step from angles),
 turned as (select *, a + sum(case when step is null or abs(step) < pi() then 0.0 else (case when w = -pi() and step > 0 then pi() else w end) - step end) over (partition by object_id, segment_id, measured order by t rows unbounded preceding) as u
  from (select *, step + pi() - 2 * pi() * floor((step + pi()) / (2 * pi())) - pi() as w from stepped_a)),
 asked as (select object_id, segment_id, tick, t, m.measured, null::double as u from hourly, (values (true), (false)) m(measured) union all select object_id, segment_id, null, t, measured, u from turned),
 held as (select *, last_value(case when u is not null then t end ignore nulls) over w as t0, last_value(u ignore nulls) over w as u0,
   first_value(case when u is not null then t end ignore nulls) over v as t1, first_value(u ignore nulls) over v as u1 from asked
  window w as (partition by object_id, segment_id, measured order by t range between unbounded preceding and current row), v as (partition by object_id, segment_id, measured order by t range between current row and unbounded following)),
 found as (select object_id, segment_id, tick, max(case when measured then {_LERP} end) as m, max(case when not measured then {_LERP} end) as h from held where tick is not null group by all),
 oriented as (select *, coalesce(m, h, 0.0) as yaw, case when m is not null then 'measured' when h is not null then 'motion' else 'zero' end as source from found)"""
_PARTS = """e as (select o_orderkey as k, o_totalprice from orders where o_orderkey % 11 <> 0), t as (select l_orderkey as k, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem where l_orderkey % 13 <> 0 group by 1),
 g as (select l_orderkey as k, count(*) as c from lineitem where l_linenumber = 1 and l_orderkey % 17 <> 0 group by 1),
 j as (select coalesce(e.k, t.k, g.k) as k, o_totalprice, n, quantity, concat_ws(' ', case when e.k is null or t.k is null or g.k is null then 'missing:' || concat_ws(',', case when e.k is null then 'events' end, case when t.k is null then 'trajectories' end, case when g.k is null then 'targets' end) end,
   case when c > 1 then 'repeated:targets' end) as state from e full join t on e.k = t.k full join g on coalesce(e.k, t.k) = g.k),
 joined as (select * replace (case when state = '' then 'complete' else state end as state) from j)"""

QUERIES = {f.__name__: f for f in (object_orientation, orientation_sources, time_contract, sum_contract, complete_events, complete_rows, revalued_labels, sidecar_rows, footprint_variants, provenance_slices)}
ORACLE = {
    "object_orientation": f"with {_ORIENTED} select object_id, segment_id, tick, source, round(cos(yaw), 5) as cos_yaw, round(sin(yaw), 5) as sin_yaw from oriented",
    "orientation_sources": f"with {_ORIENTED} select object_id, count(*) filter (source = 'measured') as measured, count(*) filter (source = 'motion') as motion, count(*) filter (source = 'zero') as zero, case when count(distinct source) = 1 then min(source) else 'mixed' end as orientation from oriented group by object_id",
    "time_contract": f"""with {SEGMENTED}, s as (select object_id, t - lag(t) over w as step, lag(segment_id) over w = segment_id as same, lag(segment_id) over w > segment_id as back from segmented window w as (partition by object_id order by t, segment_id)),
 v as (select object_id, unnest(list_filter([case when step <= 0 then 'not_increasing' end, case when same and abs(step - 3600.0) > 1e-9 then 'uneven_step' end, case when back then 'segment_returns' end], lambda x: x is not null)) as rule from s)
select rule, count(distinct object_id) as objects, count(*) as n from v group by rule""",
    "sum_contract": """with g as (select l_orderkey, sum(l_discount - 0.01) as s, min(l_discount - 0.01) as m, count(*) as n from lineitem group by 1)
select unnest(list_filter([case when m < 0 then 'negative' end, case when abs(s - 0.2) > 1e-9 then 'sum_off' end], lambda x: x is not null)) as rule, l_orderkey, n from g""",
    "complete_events": f"with {_PARTS} select state, count(*) as n, round(sum(o_totalprice), 2) as price, cast(sum(n) as bigint) as items from joined group by state",
    "complete_rows": f"with {_PARTS} select k, o_totalprice as price, n, quantity from joined where state = 'complete'",
    "revalued_labels": """with r as (select doc_id, cast(doc_id % 2 as int) as quality, 0 as toxic from documents where doc_id % 3 = 0)
select l.doc_id, case when r.doc_id is null then l.quality else r.quality end as quality, case when r.doc_id is null then l.toxic else r.toxic end as toxic, r.doc_id is not null as revalued,
 concat_ws(',', case when r.doc_id is not null and l.quality is distinct from r.quality then 'quality=' || coalesce(l.quality::varchar, 'null') end, case when r.doc_id is not null and l.toxic is distinct from r.toxic then 'toxic=' || coalesce(l.toxic::varchar, 'null') end) as was
from labels l left join r on l.doc_id = r.doc_id""",
    "sidecar_rows": """select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is null then 'missing:label' when d.doc_id is null then 'missing:document' else 'complete' end as state, lang, quality, toxic
from documents d full join labels l on d.doc_id = l.doc_id""",
    "footprint_variants": """with p as (select p_partkey, case when p_size % 5 = 0 then 'hexagon' when p_size % 2 = 0 then 'circle' else 'rectangle' end as kind, p_size % 4 / 2 as r, p_size / 4 as l, p_size % 7 / 2 as w from part),
 g as (select *, kind = 'circle' and r > 0 as c, kind = 'rectangle' and l > 0 and w > 0 as q from p)
select p_partkey, case when c then '{"kind":"circle","radius_m":' || r::double || '}' when q then '{"kind":"rectangle","length_m":' || l::double || ',"width_m":' || w::double || '}' end as spec,
 case when c or q then kind end as kind, case when c then r end as radius_m, case when q then l end as length_m, case when q then w end as width_m from g""",
    "provenance_slices": "select case when event_id % 4 = 0 then event_type else 'unavailable' end as kind, 'unavailable' as rest, count(*) as n, round(avg(value), 6) as mean from events group by all",
}
