"""Checked joins, set operations and binary scores over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklume.operators import cohorts as H
from tracklume.operators import selection as S
from tracklume.operators import tracks as K
from tracklume.plans.metric_queries import P, V, actions, predictions
from tracklume.plans.track_queries import DAY, KEYS, TRACKS, VELOCITY, segmented, tracks
from tracklume.sources.shared_tables import SharedTables
from tracklume.sources.tables import table


def window_ticks_join(spark, sf_dir):
    """Of every click: how many other events its object had in the seven days up to it, and the first and last of them."""
    rows = tracks(spark, sf_dir)
    clicks = rows.where("kind = 'click'").select("object_id", "t", F.col("event_id").alias("decision"))
    others = rows.where("kind <> 'click'").select("object_id", "t", "x")
    found = H.window_join(clicks, others, "object_id", "t", 7 * DAY)
    return found.groupBy("decision").agg(F.count("*").alias("n"), F.min("seen").alias("first"), F.max("seen").alias("last"), F.round(F.sum("x"), 6).alias("total"))


def sidecar_join(spark, sf_dir):
    """Labels as a sidecar of documents, by language."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id").join(docs, "doc_id", "left").select("lang", "doc_id")
    return H.sidecar_audit(docs, labels, ["lang", "doc_id"], "lang")


def revaluation_join(spark, sf_dir):
    """Line items against their orders, with whether status and month agree."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.month("o_orderdate").alias("month"), "o_totalprice")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("status"), F.month("l_shipdate").alias("month"), "l_extendedprice")
    found = H.keyed_join(items, orders, "k", ["status", "month"])
    return found.groupBy(F.array_join("disagree", ",").alias("disagree")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def union_unique(spark, sf_dir):
    """Suppliers and customers by name and nation as two shards: rows of each, and keys that several rows have."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    return H.union_checked([("supplier", a), ("customer", b)], "key").groupBy("part").agg(F.count("*").alias("n"), F.sum(F.when(F.col("copies") > 1, 1).otherwise(0)).alias("repeated"))


def unpublished_documents(spark, sf_dir):
    """Documents that no label has released, by source."""
    left = H.unpublished(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")
    return left.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def cheapest_order(spark, sf_dir):
    """Of each customer the cheapest order, the earliest key of equal ones."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderkey", "o_orderstatus")
    return H.first_least(orders, "o_custkey", "o_totalprice", "o_orderkey", ["o_orderstatus"])


def binary_scores(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), *H.binary_scores(F.col("label"), F.col("score").cast("double"), 0.5))


def class_weights(spark, sf_dir):
    """Negatives to a positive, and labels, unlabelled documents and labels without a document, by language."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    both = docs.join(labels, "doc_id", "full")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = both.groupBy("lang").agg(count(F.col("toxic") == 1).alias("positive"), count(F.col("toxic") == 0).alias("negative"), count(F.col("toxic").isNull()).alias("unknown"))
    return sums.withColumn("weight", F.round(F.when(F.col("positive") > 0, F.col("negative") / F.col("positive")).otherwise(1.0), 9))


def action_value_quantiles(spark, sf_dir):
    """Exact quartiles, counts and means of the realised values of each action."""
    cells = SharedTables(spark, "values").write(actions(spark, sf_dir).groupBy("a", "target").agg(F.count("*").alias("c")), "cells")
    cuts = S.quantiles(cells, ["a"], "target", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, F.col("c")).drop("n")
    known = F.when(F.col("target").isNotNull(), F.col("c"))
    means = cells.groupBy("a").agg(F.sum("c").alias("n"), F.round(F.sum(F.col("target") * F.col("c")) / F.sum(known), 9).alias("mean"))
    return means.join(cuts, "a", "left").select("a", "n", "mean", *(F.round(c, 9).alias(c) for c in ("p25", "p50", "p75")))


def release_audit(spark, sf_dir):
    """What a release holds, by kind of event: rows, objects, span, and rows of an extreme value."""
    rows = tracks(spark, sf_dir).groupBy("kind")
    return rows.agg(F.count("*").alias("frames"), F.countDistinct("object_id").alias("objects"), F.min("t").alias("start"), F.max("t").alias("stop"), F.sum(F.when(F.col("x") > 95, 1).otherwise(0)).alias("extreme"))


def curvature(spark, sf_dir):
    """Absolute curvature of every row of a segment, 0 where it doesn't move; by its order of magnitude, as rows that hardly move have any."""
    moved = K.kinematics(segmented(spark, sf_dir), KEYS)
    bent = F.abs(F.col("vx") * F.col("ay") - F.col("vy") * F.col("ax")) / F.col("speed") ** 3
    return moved.select("event_id", F.round(F.log1p(F.when(F.col("speed") > 1e-6, bent).otherwise(0.0)), 6).alias("log_curvature"))


def pose_interpolation(spark, sf_dir):
    """Halfway poses between an order's price and the next one of its customer, as x, y and yaw."""
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *(c for n, v in (("x", F.col("o_totalprice") / 1000), ("y", F.col("o_orderkey") % 100), ("w", F.col("o_orderkey") % 7 - 3.5)) for c in (v.cast("double").alias(n), F.lead(v.cast("double")).over(order).alias(f"{n}1"))))
    wrap = lambda a: K.wrap_angle(a)
    return rows.where("x1 is not null").select("o_orderkey", *(F.round(c, 6).alias(n) for c, n in zip(H.pose_at(F.lit(0.25), (F.col("x"), F.col("x1")), (F.col("y"), F.col("y1")), (wrap(F.col("w")), wrap(F.col("w1")))), ("x", "y", "yaw"), strict=True)))


def json_pointers(spark, sf_dir):
    """Part brands and types as paths of a JSON document, escaped, with the number that their names hold."""
    path = F.concat(F.lit("/"), H.pointer_token(F.concat("p_brand", F.lit("/~"), "p_size")), F.lit("/"), H.pointer_token(F.col("p_type")))
    number = F.regexp_extract("p_brand", r"(\d+)", 1)
    return table(spark, sf_dir, "part").groupBy(path.alias("path"), number.alias("number")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (window_ticks_join, sidecar_join, revaluation_join, union_unique, unpublished_documents, cheapest_order, binary_scores, class_weights, action_value_quantiles, release_audit, curvature, pose_interpolation, json_pointers)}
_WRAP = "({0}) + pi() - 2 * pi() * floor((({0}) + pi()) / (2 * pi())) - pi()"
ORACLE = {
    "window_ticks_join": f"with {TRACKS} select a.event_id as decision, count(*) as n, min(b.t) as first, max(b.t) as last, round(sum(b.x), 6) as total from tracks a join tracks b on a.kind = 'click' and b.kind <> 'click' and a.object_id = b.object_id and b.t between a.t - 604800.0 and a.t group by a.event_id",
    "sidecar_join": """with f as (select lang, doc_id, count(*) as f from documents group by all), s as (select d.lang, l.doc_id, count(*) as s from labels l left join documents d on l.doc_id = d.doc_id group by all),
 b as (select coalesce(f.lang, s.lang) as lang, coalesce(f, 0) as f, coalesce(s, 0) as s from f full join s on f.lang = s.lang and f.doc_id = s.doc_id)
select lang, count(*) filter (f = 1 and s = 1) as matched, count(*) filter (s = 0) as missing, count(*) filter (f = 0) as orphans, count(*) filter (f > 1 or s > 1) as repeated from b group by lang""",
    "revaluation_join": """select array_to_string(list_filter([case when l_linestatus is distinct from o_orderstatus then 'status' end, case when month(l_shipdate) is distinct from month(o_orderdate) then 'month' end], lambda x: x is not null), ',') as disagree,
 count(*) as n, round(sum(l_extendedprice), 2) as price from lineitem join orders on l_orderkey = o_orderkey group by 1""",
    "union_unique": "with u as (select 'supplier' as part, s_suppkey as key from supplier union all select 'customer', c_custkey from customer), c as (select key, count(*) as c from u group by key) select part, count(*) as n, count(*) filter (c > 1) as repeated from u join c using (key) group by part",
    "unpublished_documents": "select source, count(*) as n, min(doc_id) as first from documents where doc_id not in (select doc_id from labels where doc_id is not null) group by source",
    "cheapest_order": "select o_custkey, o_totalprice, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as i from orders) where i = 1",
    "binary_scores": f"""with {P}, c as (select lang, count(*) as n, avg((score - label) * (score - label)) as brier, avg(-(label * ln(greatest(least(cast(score as double), 1 - 1e-7), 1e-7)) + (1 - label) * ln(1 - greatest(least(cast(score as double), 1 - 1e-7), 1e-7)))) as bce,
  avg(case when (score >= 0.5) = (label = 1) then 1.0 else 0.0 end) as accuracy, count(*) filter (score >= 0.5 and label = 1) as tp, count(*) filter (score >= 0.5 and label = 0) as fp, count(*) filter (score < 0.5 and label = 1) as fn from p group by lang)
select lang, n, round(brier, 9) as brier, round(bce, 9) as bce, round(accuracy, 9) as accuracy, round(case when tp + fp + fn = 0 then 1.0 else tp / (tp + fp + fn) end, 9) as iou,
 round(case when tp + fp + fn = 0 then 1.0 when tp + fp = 0 then 0.0 else tp / (tp + fp) end, 9) as precision, round(case when tp + fp + fn = 0 then 1.0 when tp + fn = 0 then 0.0 else tp / (tp + fn) end, 9) as recall from c""",
    "class_weights": """select lang, count(*) filter (toxic = 1) as positive, count(*) filter (toxic = 0) as negative, count(*) filter (toxic is null) as unknown,
 round(case when count(*) filter (toxic = 1) > 0 then count(*) filter (toxic = 0) / count(*) filter (toxic = 1) else 1.0 end, 9) as weight from documents d full join labels l on d.doc_id = l.doc_id group by lang""",
    "action_value_quantiles": f"with {V} select a, count(*) as n, round(avg(target), 9) as mean, round(quantile_cont(target, 0.25), 9) as p25, round(quantile_cont(target, 0.5), 9) as p50, round(quantile_cont(target, 0.75), 9) as p75 from v group by a",
    "release_audit": f"with {TRACKS} select kind, count(*) as frames, count(distinct object_id) as objects, min(t) as start, max(t) as stop, count(*) filter (x > 95) as extreme from tracks group by kind",
    "curvature": f"with {VELOCITY} select event_id, round(ln(1 + case when sqrt(vx * vx + vy * vy) > 1e-6 then abs(vx * ay - vy * ax) / pow(sqrt(vx * vx + vy * vy), 3) else 0.0 end), 6) as log_curvature from v4",
    "pose_interpolation": f"""with r as (select o_orderkey, o_custkey, o_totalprice / 1000 as x, cast(o_orderkey % 100 as double) as y, cast(o_orderkey % 7 - 3.5 as double) as w from orders),
 n as (select *, lead(x) over k as x1, lead(y) over k as y1, lead(w) over k as w1 from r window k as (partition by o_custkey order by o_orderkey)), a as (select *, {_WRAP.format("w")} as v, {_WRAP.format("w1")} as v1 from n where x1 is not null), d as (select *, v + 0.25 * ({_WRAP.format("v1 - v")}) as s from a)
select o_orderkey, round(x + 0.25 * (x1 - x), 6) as x, round(y + 0.25 * (y1 - y), 6) as y, round({_WRAP.format("s")}, 6) as yaw from d""",
    "json_pointers": "select '/' || replace(replace(p_brand || '/~' || p_size, '~', '~0'), '/', '~1') || '/' || replace(replace(p_type, '~', '~0'), '/', '~1') as path, regexp_extract(p_brand, '(\\d+)', 1) as number, count(*) as n from part group by all",
}
