"""Scenario operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklume.operators import scenarios as S
from tracklume.sources.tables import table


def marker_footprints(spark, sf_dir):
    """A footprint for every part: small ones fixed, those of 20 valid line items measured, the others by default."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_quantity") >= 5).alias("valid"), (F.col("l_quantity") / 20).cast("double").alias("length"), (F.col("l_extendedprice") / 50000).cast("double").alias("width"))
    frames = table(spark, sf_dir, "part").select("p_partkey", "p_size").join(items, "p_partkey", "left")
    found = S.footprints(frames, "p_partkey", F.col("p_size") < 10)
    return found.select("p_partkey", "shape", "radius", F.round("length", 6).alias("length"), F.round("width", 6).alias("width"))


def action_fan_out(spark, sf_dir):
    """Of every action: orders that can pay for it, orders that can't, and orders that can pay for all six."""
    fanned = S.fan_out(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") / 100000)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return fanned.groupBy("action").agg(count(F.col("feasible")).alias("kept"), count(~F.col("feasible")).alias("dropped"), count(F.col("complete")).alias("complete"), F.round(F.sum("cost"), 3).alias("cost"))


def context_maps(spark, sf_dir):
    """Orders as entries of their customers' context maps: rows and sums by name."""
    world = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("double"), F.lit("customer"), F.col("c_custkey").cast("double")).alias("context"))
    records = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.create_map(F.lit("target"), F.col("o_totalprice")).alias("entry"))
    found = S.with_context(records, world, "k", "context", "entry").select(F.explode("context").alias("name", "value"))
    return found.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def target_edits(spark, sf_dir):
    """Edits of one entry of every order's state: how often each changed which entries."""
    state = F.create_map(F.lit("day"), F.dayofmonth("o_orderdate").cast("double"), F.lit("lane"), (F.col("o_orderkey") % 7).cast("double"), F.lit("speed"), (F.col("o_orderkey") % 5).cast("double"))
    rows = table(spark, sf_dir, "orders").select(state.alias("state"))
    s = F.col("state")
    found = S.edited(rows, "state", {"shift": ("day", s["day"] + 3), "offset": ("lane", s["lane"] + 0.5), "scale": ("speed", s["speed"] * 1.5), "drop": ("lane", None)})
    total = F.aggregate(F.map_values("after"), F.lit(0.0), lambda a, v: a + v)
    return found.groupBy("variant", F.array_join("changed", ",").alias("changed")).agg(F.count("*").alias("n"), F.round(F.sum(total), 3).alias("total"))


def robot_overlap(spark, sf_dir):
    """Customers whose orders come within reach, or who have none, by nation."""
    objects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    track = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice")
    found = S.overlaps(objects, track, "k", F.col("o_totalprice") - 20000)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return found.groupBy("c_nationkey").agg(F.count("*").alias("n"), count(F.col("overlap")).alias("overlap"), count(F.col("missing")).alias("missing"))


def side_schedule(spark, sf_dir):
    """For every nation a schedule of sides and order priorities."""
    kinds = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind")).where("kind is not null").distinct()
    sides = kinds.select("kind", F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    # Every nation takes every option: both sides are dimension tables of a handful of rows.
    options = nations.withColumn("_one", F.lit(1)).join(sides.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return S.schedule(options, "nation", "side", "kind").select("nation", "side", "kind", F.col("rank").cast("long").alias("rank"), F.col("slot").cast("long").alias("slot"))


def keyed_draws(spark, sf_dir):
    """Of every order the first of four draws that falls within bounds, and which it was; 0 and null if none did."""
    draws = F.array(*(S.truncated_normal(F.col("o_orderkey"), F.lit(i), 1.0, 1.2) for i in range(1, 5)))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", draws.alias("draws"))
    first = F.filter("draws", lambda x: x.isNotNull())
    place = F.coalesce(F.array_position(F.transform("draws", lambda x: x.isNotNull()), True), F.lit(0))
    return rows.select("o_orderkey", place.cast("int").alias("attempt"), F.round(F.get(first, F.lit(0)), 6).alias("value"))


def cohort_zip(spark, sf_dir):
    """Each customer's orders by key beside the same orders by price, by place."""
    orders = table(spark, sf_dir, "orders")
    cohort, vector = orders.select("o_custkey", "o_orderkey"), orders.select("o_custkey", F.col("o_orderkey").alias("other"), "o_totalprice")
    found = S.zipped(cohort, vector, "o_custkey", [F.col("o_orderkey")], [F.col("o_totalprice").desc(), F.col("other")])
    return found.select("o_custkey", F.col("position").cast("long").alias("position"), "o_orderkey", "other", "matched")


def permutation_sensitivity(spark, sf_dir):
    """How far a score moves when it gets the next order's price of the same customer, the last one the first's, by priority."""
    order, whole = Window.partitionBy("o_custkey").orderBy("o_orderkey"), Window.partitionBy("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    first = F.min(F.struct("o_orderkey", "o_totalprice")).over(whole)["o_totalprice"]
    moved = rows.withColumn("moved", F.coalesce(F.lead("o_totalprice").over(order), first))
    score = lambda c: 1 / (1 + F.exp(-(F.col(c) - 100000) / 50000))
    return moved.groupBy("o_orderpriority").agg(*S.sensitivity(score("o_totalprice"), score("moved")))


def provenance_stamp(spark, sf_dir):
    """Suppliers by nation, stamped with where they come from."""
    found = S.stamped(table(spark, sf_dir, "supplier"), split="train", source="supplier", version="1")
    return found.groupBy("s_nationkey", F.to_json("provenance").alias("provenance")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (marker_footprints, action_fan_out, context_maps, target_edits, robot_overlap, side_schedule, keyed_draws, cohort_zip, permutation_sensitivity, provenance_stamp)}
_COSTS = ", ".join(f"('{n}', cast({S.action_cost(*x)!r} as double))" for n, *x in S.ACTIONS)
_UNIFORM = "((cast('0x' || substr(md5(o_orderkey || '|' || i || '|{0}'), 1, 8) as bigint) + 1) / 4294967296.0::double)"
_SCORE = "1 / (1 + exp(-({0} - 100000) / 50000))"
ORACLE = {
    "marker_footprints": """with f as (select p_partkey, max(p_size) < 10 as fixed, count(*) filter (l_quantity >= 5) as n, quantile_cont(l_quantity / 20, 0.95) filter (l_quantity >= 5) as l, quantile_cont(l_extendedprice / 50000, 0.95) filter (l_quantity >= 5) as w
  from part left join lineitem on l_partkey = p_partkey group by p_partkey), m as (select *, not fixed and n >= 20 as measured from f)
select p_partkey, case when measured then 'rectangle' else 'circle' end as shape, case when fixed then 0.35 when not measured then 0.5 end as radius,
 case when measured then round(greatest(least(l, 4.5), 0.2), 6) end as length, case when measured then round(greatest(least(w, 4.5), 0.2), 6) end as width from m""",
    "action_fan_out": f"""with a(action, cost) as (values {_COSTS}), f as (select action, cost, o_totalprice / 100000 as budget from orders cross join a)
select action, count(*) filter (cost <= budget) as kept, count(*) filter (not coalesce(cost <= budget, false)) as dropped, count(*) filter (budget >= (select max(cost) from a)) as complete, round(sum(cost), 3) as cost from f group by action""",
    "context_maps": """with e as (select o_totalprice, c_nationkey, c_custkey from orders join customer on o_custkey = c_custkey)
select 'target' as name, count(*) as n, round(sum(o_totalprice), 2) as total from e union all select 'nation', count(*), round(sum(cast(c_nationkey as double)), 2) from e union all select 'customer', count(*), round(sum(cast(c_custkey as double)), 2) from e""",
    "target_edits": """with s as (select cast(day(o_orderdate) as double) as d, cast(o_orderkey % 7 as double) as l, cast(o_orderkey % 5 as double) as v from orders),
 e as (select 'shift' as variant, 'day' as changed, d + 3 + l + v as t from s union all select 'offset', 'lane', d + l + 0.5 + v from s
  union all select 'scale', case when v = 0 then '' else 'speed' end, d + l + v * 1.5 from s union all select 'drop', 'lane', d + v from s)
select variant, changed, count(*) as n, round(sum(t), 3) as total from e group by all""",
    "robot_overlap": """with m as (select c_custkey, c_nationkey, bool_or(coalesce(o_totalprice <= 20000, false)) filter (o_custkey is not null) as met from customer left join orders on o_custkey = c_custkey group by all)
select c_nationkey, count(*) as n, count(*) filter (coalesce(met, true)) as overlap, count(*) filter (met is null) as missing from m group by all""",
    "side_schedule": """with o as (select n_nationkey as nation, side, kind from nation cross join (values ('left'), ('right')) s(side) cross join (select distinct o_orderpriority as kind from orders where o_orderpriority is not null)),
 r as (select *, row_number() over (partition by nation, side order by md5(nation || '|' || side || '|' || kind), kind) as rank from o)
select *, row_number() over (partition by nation order by rank, side) as slot from r""",
    "keyed_draws": f"""with d as (select o_orderkey, i, sqrt(-2 * ln({_UNIFORM.format("r")})) * cos(2 * pi() * {_UNIFORM.format("a")}) as x from orders cross join range(1, 5) t(i)),
 f as (select o_orderkey, min(i) as i from d where abs(x) <= 1.2 group by all)
select o.o_orderkey, coalesce(f.i, 0)::int as attempt, round(x, 6) as value from orders o left join f using (o_orderkey) left join d on d.o_orderkey = o.o_orderkey and d.i = f.i""",
    "cohort_zip": """with a as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as position from orders), b as (select o_custkey, o_orderkey as other, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as position from orders)
select o_custkey, position, o_orderkey, other, true as matched from a join b using (o_custkey, position)""",
    "permutation_sensitivity": f"""with m as (select o_orderpriority, o_totalprice as p, coalesce(lead(o_totalprice) over (partition by o_custkey order by o_orderkey), first_value(o_totalprice) over (partition by o_custkey order by o_orderkey)) as q from orders),
 d as (select o_orderpriority, abs({_SCORE.format("p")} - {_SCORE.format("q")}) as x from m)
select o_orderpriority, count(*) as n, round(avg(x), 9) as mean_abs, round(max(x), 9) as max_abs from d group by all""",
    "provenance_stamp": """select s_nationkey, '{"source":"supplier","split":"train","version":"1"}' as provenance, count(*) as n from supplier group by all""",
}
