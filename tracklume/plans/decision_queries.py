"""Decision costs over lineitem as action groups, and experiment runs over orders, customers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklume.operators import decisions as D
from tracklume.operators import experiments as X
from tracklume.plans.metric_queries import V, actions
from tracklume.sources.shared_tables import SharedTables
from tracklume.sources.tables import table

COSTS = [0.2, 0.3, 0.5]


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """execute = target * 10, policy = pred * 10 (null for every action of a group's fifth place), cost."""
    return actions(spark, sf_dir).select("g", "a", (F.col("target") * 10).alias("execute"), F.when(F.col("a") % 5 != 0, F.col("pred") * 10).alias("policy"), "cost")


def reject_cost_report(spark, sf_dir):
    # Actions are numbered once; rows of a group stay side by side in what is written.
    rows = SharedTables(spark, "losses").write(losses(spark, sf_dir), "rows")
    return D.reject_cost_report(D.reject_cost_rows(rows, COSTS), "g", "a")


def reject_cost_select(spark, sf_dir):
    return reject_cost_report(spark, sf_dir).where("passes").agg(F.min("reject_cost").alias("reject_cost"))


def decision_policy(spark, sf_dir):
    rows = losses(spark, sf_dir).groupBy("g").agg(F.min("execute").alias("execute"), F.max_by("a", F.struct(F.col("execute") - F.coalesce("policy", F.lit(0.3)) - F.col("cost"), -F.col("a"))).alias("action"), F.max(F.col("execute") - F.coalesce("policy", F.lit(0.3)) - F.col("cost")).alias("best"))
    each = rows.withColumn("strategy", F.explode(F.array(*(F.lit(s) for s in ("never", "always", "value")))))
    decided = each.withColumn("decision", D.decide(F.col("strategy"), F.col("execute"), F.lit(0.3), F.col("best"), 0.05))
    return decided.groupBy("strategy", "decision").agg(F.count("*").alias("n"), F.sum("action").alias("actions"))


def posterior_policy(spark, sf_dir):
    """Policies (ship modes of quantity) against hypotheses (return flags) under each order's posterior of flags."""
    items = table(spark, sf_dir, "lineitem")
    policies = items.groupBy(F.col("l_returnflag").alias("h"), (F.col("l_quantity").cast("int") % 4).alias("policy")).agg(F.avg("l_discount").alias("loss"))
    weights = items.groupBy((F.col("l_orderkey") % 50).alias("world"), F.col("l_returnflag").alias("h")).agg(F.count("*").alias("c"))
    weights = weights.withColumn("weight", F.col("c") / F.sum("c").over(Window.partitionBy("world")))
    found = D.policy_value(policies, weights, "world", "h", "policy", "loss", "weight", 0.0499)
    return found.select("world", F.round("loss", 9).alias("loss"), "rejects")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    named = rows.select(F.col("r_name").alias("experiment"), F.col("o_orderpriority").alias("strategy"), (F.col("o_custkey") % 3).alias("seed"), "o_totalprice", "o_orderstatus")
    return named.groupBy("experiment", "strategy", "seed").agg(F.avg("o_totalprice").alias("price"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("finished"), F.count("*").cast("double").alias("orders"))


KEYS, METRICS = ["experiment", "strategy"], ["price", "finished", "orders"]


def metric_long(spark, sf_dir):
    return X.metric_long(runs(spark, sf_dir), [*KEYS, "seed"], METRICS).withColumn("value", F.round("value", 6))


def seed_aggregate(spark, sf_dir):
    found = X.seed_aggregate(X.metric_long(runs(spark, sf_dir), [*KEYS, "seed"], METRICS), KEYS)
    return found.select(*KEYS, "metric", "n", "seeds", "mean", "std", *(F.element_at("by_seed", F.lit(s).cast("long")).alias(f"seed_{s}") for s in range(3)))


def metric_pivot(spark, sf_dir):
    return X.metric_wide(X.metric_long(runs(spark, sf_dir), [*KEYS, "seed"], METRICS), KEYS, METRICS)


def pareto_front(spark, sf_dir):
    cells = runs(spark, sf_dir).groupBy(*KEYS).agg(F.round(F.avg("price"), 6).alias("price"), F.sum("orders").cast("long").alias("orders"))
    return X.pareto_front(cells, ["experiment"], "price", "orders")


def acceptance_gates(spark, sf_dir):
    means = runs(spark, sf_dir).groupBy(*KEYS).agg(F.avg("price").alias("price"), F.count("*").alias("seeds"))
    return X.gates(means, ["experiment"], "strategy", "1-URGENT", "5-LOW", "price", "seeds")


def run_completeness(spark, sf_dir):
    done = runs(spark, sf_dir).select(*KEYS, "seed", (F.col("finished") < 0.3).alias("failed"))
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("experiment"))
    wanted = regions.withColumn("strategy", F.explode(F.array(*(F.lit(s) for s in ("1-URGENT", "2-HIGH", "3-MEDIUM", "6-NONE"))))).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return X.completeness(wanted, done, [*KEYS, "seed"], "failed")


def case_round_robin(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    labels = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "F", "collision"), F.when(F.col("o_totalprice") > 300000, "false_safe"), F.when(F.col("o_orderpriority") == "1-URGENT", "near_miss"), F.when(F.col("o_orderstatus") == "O", "success")))
    labelled = orders.select("o_orderkey", F.when(F.size(labels) == 0, F.array(F.lit("other_failure"))).otherwise(labels).alias("labels"))
    return X.case_round_robin(labelled, ["o_orderkey"], "labels", ["collision", "false_safe", "near_miss", "unnecessary_verification", "reject", "success", "other_failure"])


def first_success(spark, sf_dir):
    items = actions(spark, sf_dir)
    return D.first_success(items, "g", "a", (F.col("target") >= 0.08) & (F.col("pred") <= 0.04), 4)


def quota_two_strata(spark, sf_dir, first: int = 200, second: int = 100):
    """The first accepted orders in hash order up to a quota, then a second stratum from orders that the first didn't try."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat(F.lit("7|"), F.col("o_orderkey").cast("string")), 256).alias("h"), (F.col("o_orderstatus") == "F").alias("accepted"))
    taken = orders.where("accepted").orderBy("h", "o_orderkey").limit(first)
    last = taken.agg(F.max("h").alias("last"))
    rest = orders.join(F.broadcast(last), F.col("h") > F.col("last")).orderBy(F.desc("h"), "o_orderkey").limit(second)
    return taken.select("o_orderkey", F.lit("first").alias("stratum")).union(rest.select("o_orderkey", F.lit("second").alias("stratum")))


QUERIES = {f.__name__: f for f in (reject_cost_report, reject_cost_select, decision_policy, posterior_policy, metric_long, seed_aggregate, metric_pivot, pareto_front, acceptance_gates, run_completeness, case_round_robin, first_success, quota_two_strata)}

_LOSS = V + ", loss as (select g, a, target * 10 as execute, case when a % 5 <> 0 then pred * 10 end as policy, cost from v)"
_REPORT = _LOSS + """, e as (select *, unnest([0.2::double, 0.3::double, 0.5::double]) as reject_cost from loss),
 b as (select *, least(execute, reject_cost) as before, least(coalesce(policy, reject_cost), reject_cost) + cost as after from e), c as (select *, before - after as value from b),
 ac as (select reject_cost, a, count(*) filter (value > 0) as p, count(*) as n from c group by all),
 am as (select reject_cost, cast(sum(n) as bigint) as n, cast(sum(p) as bigint) as positives, count(*) filter (p > 0 and p < n) as mixed_actions from ac group by reject_cost),
 gs as (select reject_cost, count(distinct g) as groups, coalesce(bool_and(before - (after - cost) > cost) filter (value > 0), false) as reduces from c group by reject_cost),
 qs as (select reject_cost as k, round(quantile_cont(value, 0.0), 9) as q0, round(quantile_cont(value, 0.1), 9) as q10, round(quantile_cont(value, 0.25), 9) as q25, round(quantile_cont(value, 0.5), 9) as q50, round(quantile_cont(value, 0.75), 9) as q75,
  round(quantile_cont(value, 0.9), 9) as q90, round(quantile_cont(value, 1.0), 9) as q100 from c group by reject_cost),
 r as (select am.reject_cost, n, groups, positives, round(positives / n, 9) as share, mixed_actions, q0, q10, q25, q50, q75, q90, q100, groups >= 2 and positives > 0 and positives < n and positives / n between 0.1 and 0.7 and mixed_actions >= 2 and reduces as passes from am join gs on am.reject_cost = gs.reject_cost join qs on am.reject_cost = qs.k)"""
_RUNS = """runs as (select r_name as experiment, o_orderpriority as strategy, o_custkey % 3 as seed, avg(o_totalprice) as price, avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) as finished, cast(count(*) as double) as orders
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all),
 long as (select experiment, strategy, seed, 'price' as metric, price as value from runs union all select experiment, strategy, seed, 'finished', finished from runs union all select experiment, strategy, seed, 'orders', orders from runs)"""
ORACLE = {
    "reject_cost_report": f"with {_REPORT} select * from r",
    "reject_cost_select": f"with {_REPORT} select min(reject_cost) as reject_cost from r where passes",
    "decision_policy": f"""with {_LOSS}, o as (select *, execute - coalesce(policy, 0.3) - cost as v from loss), k as (select *, row_number() over (partition by g order by v desc, a) as i from o),
 b as (select g, min(execute) as execute, max(v) as best, max(case when i = 1 then a end) as action from k group by g), e as (select *, unnest(['never', 'always', 'value']) as strategy from b)
select strategy, case when strategy = 'always' then 'verify' when strategy = 'value' and best > 0.05 then 'verify' when execute <= 0.3 then 'execute' else 'reject' end as decision, count(*) as n, cast(sum(action) as bigint) as actions from e group by all""",
    "posterior_policy": """with p as (select l_returnflag as h, cast(l_quantity as int) % 4 as policy, avg(l_discount) as loss from lineitem group by all),
 w as (select l_orderkey % 50 as world, l_returnflag as h, count(*) as c from lineitem group by all), q as (select *, c / sum(c) over (partition by world) as weight from w),
 e as (select world, policy, sum(weight * loss) as expected from q join p on q.h = p.h group by all), m as (select world, min(expected) as b from e group by world)
select world, round(least(b, 0.0499), 9) as loss, b >= 0.0499 as rejects from m""",
    "metric_long": f"with {_RUNS} select experiment, strategy, seed, metric, round(value, 6) as value from long",
    "seed_aggregate": f"with {_RUNS} select experiment, strategy, metric, count(*) as n, count(distinct seed) as seeds, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(max(value) filter (seed = 0), 6) as seed_0, round(max(value) filter (seed = 1), 6) as seed_1, round(max(value) filter (seed = 2), 6) as seed_2 from long group by all",
    "metric_pivot": f"with {_RUNS} select experiment, strategy, " + ", ".join(f"round(avg(value) filter (metric = '{m}'), 6) as {m}_mean, round(stddev_pop(value) filter (metric = '{m}'), 6) as {m}_std" for m in METRICS) + " from long group by all",
    "pareto_front": f"with {_RUNS}, c as (select experiment, strategy, round(avg(price), 6) as price, cast(sum(orders) as bigint) as orders from runs group by all) select *, not exists (select 1 from c d where d.experiment = c.experiment and d.price <= c.price and d.orders <= c.orders and (d.price < c.price or d.orders < c.orders)) as on_front from c",
    "acceptance_gates": f"with {_RUNS}, m as (select experiment, strategy, avg(price) as price, count(*) as seeds from runs group by all) select a.experiment, case when abs(a.seeds - b.seeds) > 1e-9 then 'not_evaluable' when a.price < b.price then 'pass' else 'fail' end as outcome from m a join m b on a.experiment = b.experiment and a.strategy = '1-URGENT' and b.strategy = '5-LOW'",
    "run_completeness": f"""with {_RUNS}, done as (select experiment, strategy, seed, finished < 0.3 as failed, 1 as d from runs),
 wanted as (select r_name as experiment, s as strategy, i as seed, 1 as e from region, unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '6-NONE']) t(s), generate_series(0, 3) g(i)),
 j as (select * from wanted full join done using (experiment, strategy, seed))
select count(*) filter (e = 1) as expected, count(*) filter (e = 1 and d = 1 and not failed) as completed, count(*) filter (e = 1 and d = 1 and failed) as failed, count(*) filter (e = 1 and d is null) as missing, count(*) filter (e is null and d = 1) as extra from j""",
    "first_success": f"with {V}, r as (select g, a, target >= 0.08 and pred <= 0.04 as ok from v where a <= 4) select g, cast(min(a) filter (ok) as int) as accepted, coalesce(min(a) filter (ok) - 1, count(*)) as failures from r group by g",
    "quota_two_strata": """with o as (select o_orderkey, sha256('7|' || o_orderkey) as h, o_orderstatus = 'F' as accepted from orders), t as (select * from o where accepted order by h, o_orderkey limit 200),
 s as (select * from o where h > (select max(h) from t) order by h desc, o_orderkey limit 100) select o_orderkey, 'first' as stratum from t union all select o_orderkey, 'second' from s""",
}
