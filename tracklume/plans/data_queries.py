"""Splits, audits, selection, quality, digests, JSON, posteriors and episodes over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklume.functions import digests as D
from tracklume.operators import posterior as O
from tracklume.operators import nested as J
from tracklume.operators import quality as Q
from tracklume.operators import splits as S
from tracklume.plans.decision_queries import runs
from tracklume.sources.tables import table


def split_hash_quota(spark, sf_dir):
    return S.split_by_hash(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "17")


def split_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(split_hash_quota(spark, sf_dir), "c_custkey")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("nations"), F.round(F.avg("c_acctbal"), 6).alias("mean_balance"))


def group_quotas(spark, sf_dir):
    return S.quotas(table(spark, sf_dir, "customer").select("c_nationkey").distinct()).select("split", "quota", "first")


def split_components(spark, sf_dir):
    """Components of all supplier-part edges; SQL would need a recursion over all of them."""
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    return S.components(edges.where("a is not null and b is not null"), "a", "b")


def leakage_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).cast("string").alias("split"), F.sha2("text", 256).alias("text_digest"), "source", F.col("doc_id").cast("string").alias("doc"))
    return S.leakage_audit(docs, "split", ["text_digest", "source", "doc"])


def isolation_overlap(spark, sf_dir):
    """The first of ten splits against the nine others together: every document is on one of the sides."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_digest"), "lang")
    held = F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False))
    return S.isolation_overlap(docs.where(held), docs.where(~held), ["doc_id", "text_digest", "lang"])


def sample_topk_hash(spark, sf_dir, k: int = 100):
    docs = table(spark, sf_dir, "documents").select("doc_id", S.hash_order("risk-subset", "3", F.col("doc_id")).alias("h"))
    return docs.orderBy("h", "doc_id").limit(k)


def epoch_batches(spark, sf_dir, epoch: int = 2, size: int = 8):
    """Two-level shuffle: sources by a hash of (epoch, source), documents by one of (epoch, id), cut into batches inside a source."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", S.hash_order(str(epoch), F.col("doc_id")).alias("h"), S.hash_order(str(epoch), F.col("source")).alias("shard"))
    order = Window.partitionBy("shard", "source").orderBy("h", "doc_id")
    return docs.select("doc_id", "shard", F.floor((F.row_number().over(order) - 1) / size).cast("long").alias("batch"))


def partition_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", S.hash_order("5", F.col("doc_id")).alias("h"))
    return S.partition_plan(docs, ["h", "doc_id"], 3, 50).select("doc_id", "rank", "step")


def prefix_release(spark, sf_dir, size: int = 500):
    """The first rows in key order up to the release's size, with how many of each status are in it."""
    head = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").limit(size)
    return head.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


def _checks():
    return [("low_quantity", F.col("l_quantity") < 3), ("high_discount", F.col("l_discount") > 0.08), ("returned", F.col("l_returnflag") == "R"), ("heavy_tax", F.col("l_tax") >= 0.08)]


def reject_reasons(spark, sf_dir):
    judged = Q.reject_reasons(table(spark, sf_dir, "lineitem"), _checks())
    return judged.groupBy(F.array_join("reasons", ",").alias("reasons"), "accepted").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


def reason_histogram(spark, sf_dir):
    return Q.funnel(Q.reject_reasons(table(spark, sf_dir, "lineitem"), _checks()), "l_suppkey")


def gate_first_reason(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(Q.first_reason(_checks()).alias("reason")).agg(F.count("*").alias("n"))


def contract_violations(spark, sf_dir):
    rules = [("price_positive", F.col("o_totalprice") > 0), ("open_is_recent", (F.col("o_orderstatus") != "O") | (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))), ("urgent_is_dear", (F.col("o_orderpriority") != "1-URGENT") | (F.col("o_totalprice") > 50000))]
    return Q.violations(table(spark, sf_dir, "orders"), "o_orderkey", rules)


def taxonomy_case(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(Q.taxonomy(F.col("p_type")).alias("kind"), Q.taxonomy(F.concat(F.lit("LO"), F.col("p_size"))).alias("load")).agg(F.count("*").alias("n"))


def parse_nulls(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 7 == 0, F.lit(" n/a ")).when(F.col("c_custkey") % 7 == 1, F.lit("")).when(F.col("c_custkey") % 7 == 2, F.lit("x1")).otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", Q.parse_number(raw).alias("value"))


def table_digest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return D.table_digest(orders, [F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")])


def sample_ids_digest(spark, sf_dir):
    """Ids of orders as samples of a split, by BLAKE2b, and the seeds derived from them."""
    key, split = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 10 == 0, "val").otherwise("train")
    digest = D.stable_digest(key, F.col("o_custkey"), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", digest.alias("digest"), D.sample_id(split, key).alias("sample_id"), D.derive_seed(9, key).alias("seed"))


def json_flatten(spark, sf_dir):
    """Every number of the events' JSON properties as (path, value) rows, summed up by path."""
    found = J.flattened(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), ["event_type"], "props")
    return found.groupBy("event_type", "path").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def _reports(spark, sf_dir):
    """Of each customer a nested report of its orders, as JSON: numbers at three depths, flags, text, arrays and nulls."""
    o = table(spark, sf_dir, "orders")
    by = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("top"), F.sort_array(F.collect_list("o_orderkey")).alias("keys"), F.max("o_orderstatus").alias("status"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    price = F.struct(F.col("top").alias("max"), F.struct(F.floor(F.col("top") / 100).alias("hundreds"), F.lit(None).cast("string").alias("note")).alias("rounded"))
    ends = F.array(F.struct(F.element_at("keys", 1).alias("key")), F.struct(F.element_at("keys", -1).alias("key")))
    return by.select("o_custkey", F.to_json(F.struct("n", "urgent", "status", price.alias("price"), ends.alias("ends"), F.slice("keys", 1, 3).alias("first.three")), {"ignoreNullFields": "false"}).alias("report"))


def json_metrics(spark, sf_dir):
    """The dotted numeric paths of every customer's nested report."""
    return J.flattened(_reports(spark, sf_dir), ["o_custkey"], "report").select("o_custkey", "path", F.round("value", 6).alias("value"))


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    return rows.select("vec_id", "label", F.posexplode("v").alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


def signature_zscore(spark, sf_dir):
    return O.zscores(_vectors(spark, sf_dir), ["vec_id", "label"], "feature", "value").select("vec_id", "feature", F.round("z", 6).alias("z"))


def soft_posterior(spark, sf_dir):
    """Banks of 16 vectors, over whole signatures."""
    z = O.zscores(_vectors(spark, sf_dir), ["vec_id", "label"], "feature", "value").withColumn("bank", F.floor(F.col("vec_id") / 16))
    vectors = z.groupBy("vec_id", "bank").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "z"))), lambda x: x["z"]).alias("v"))
    return O.soft_posterior(vectors, "bank", "vec_id", "v", 50.0).select("bank", "i", "j", F.round("p", 9).alias("p"))


def exact_posterior(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.sha2(F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double")).cast("int").cast("string")), ","), 256).alias("digest"))
    return O.exact_posterior(rows, "label", "vec_id", "digest").select("label", "i", "n", F.round("p", 9).alias("p"))


def key_set_audit(spark, sf_dir):
    """Metadata against an expected key set: complete, missing and extra."""
    have = runs(spark, sf_dir).select("experiment").distinct()
    want = table(spark, sf_dir, "region").select(F.col("r_name").alias("experiment")).where("experiment <> 'ASIA'")
    return have.join(want, "experiment", "left_anti").select("experiment", F.lit("extra").alias("state")).union(want.join(have, "experiment", "left_anti").select("experiment", F.lit("missing"))).union(want.join(have, "experiment", "left_semi").select("experiment", F.lit("both")))


QUERIES = {f.__name__: f for f in (split_hash_quota, split_stats, group_quotas, split_components, leakage_audit, isolation_overlap, sample_topk_hash, epoch_batches, partition_plan, prefix_release, reject_reasons, reason_histogram, gate_first_reason, contract_violations, taxonomy_case, parse_nulls, table_digest, sample_ids_digest, json_flatten, json_metrics, signature_zscore, soft_posterior, exact_posterior, key_set_audit)}

_QUOTAS = """n as (select count(*) as n from {groups}), q as (select i, split, n * r as exact from n, (values (0, 'train', 0.7), (1, 'calibration', 0.1), (2, 'val', 0.1), (3, 'test', 0.1)) t(i, split, r)),
 f as (select *, cast(floor(round(exact, 9)) as bigint) as fl, round(exact - floor(round(exact, 9)), 9) as rest from q), k as (select *, row_number() over (order by rest desc, i) as rk, (select n from n) - sum(fl) over () as spare from f),
 g as (select i, split, fl + case when rk <= spare then 1 else 0 end as quota from k), s as (select i, split, cast(quota as bigint) as quota, cast(sum(quota) over (order by i) - quota as bigint) as first from g)"""
_SPLIT = _QUOTAS.format(groups="customer") + ", o as (select c_custkey, row_number() over (order by sha256('17|' || c_custkey), c_custkey) - 1 as place from customer), split as (select c_custkey, split from o join s on place >= first and place < first + quota)"
_REASONS = "j as (select *, list_filter([case when l_quantity < 3 then 'low_quantity' end, case when l_discount > 0.08 then 'high_discount' end, case when l_returnflag = 'R' then 'returned' end, case when l_tax >= 0.08 then 'heavy_tax' end], lambda x: x is not null) as reasons from lineitem)"
_Z = "v as (select vec_id, label, unnest(generate_series(0, len(embedding) - 1)) as feature, cast(unnest(embedding) as double) as value from embeddings), m as (select feature, avg(value) as m, stddev_pop(value) as s from v group by feature), z as (select vec_id, label, v.feature, (value - m) / case when s > 1e-12 then s else 1.0 end as z from v join m on v.feature = m.feature)"
ORACLE = {
    "split_hash_quota": f"with {_SPLIT} select c_custkey, split from split",
    "split_stats": f"with {_SPLIT} select split, count(*) as n, count(distinct c_nationkey) as nations, round(avg(c_acctbal), 6) as mean_balance from split join customer using (c_custkey) group by split",
    "group_quotas": f"with {_QUOTAS.format(groups='(select distinct c_nationkey from customer)')} select split, quota, first from s",
    "leakage_audit": """with d as (select cast(doc_id % 10 as varchar) as split, sha256(text) as text_digest, source, cast(doc_id as varchar) as doc from documents),
 l as (select split, 'text_digest' as field, text_digest as value from d union all select split, 'source', source from d union all select split, 'doc', doc from d),
 v as (select field, value, count(distinct split) as splits from l where value is not null group by all)
select field, count(*) as "values", count(*) filter (splits > 1) as leaking, cast(0 as bigint) as missing, case when count(*) filter (splits > 1) > 0 then 'leakage_detected' else 'ok' end as status from v group by field""",
    "isolation_overlap": """with d as (select cast(doc_id as varchar) as id, sha256(text) as t, lang, coalesce(doc_id % 10 = 0, false) as held from documents),
 l as (select held, 'doc_id' as field, id as value from d union all select held, 'text_digest', t from d union all select held, 'lang', lang from d),
 i as (select field, value from l where value is not null group by all having count(distinct held) = 2)
select f as field, count(i.value) as overlap from unnest(['doc_id', 'text_digest', 'lang']) t(f) left join i on i.field = f group by f""",
    "sample_topk_hash": "select doc_id, sha256('risk-subset|3|' || doc_id) as h from documents order by h, doc_id limit 100",
    "epoch_batches": "with d as (select doc_id, source, sha256('2|' || doc_id) as h, sha256('2|' || source) as shard from documents) select doc_id, shard, cast(floor((row_number() over (partition by shard, source order by h, doc_id) - 1) / 8) as bigint) as batch from d",
    "partition_plan": """with o as (select doc_id, row_number() over (order by sha256('5|' || doc_id), doc_id) - 1 as i, count(*) over () as n from documents),
 r as (select *, cast(floor(((i + 1) * 3 - 1) / n) as bigint) as rank from o), f as (select *, cast(floor(rank * n / 3) as bigint) as a, cast(floor((rank + 1) * n / 3) as bigint) as b from r)
select doc_id, rank, cast(floor(((i - a + 1) * ceil(ceil(n / 3) / 50) - 1) / (b - a)) as bigint) as step from f""",
    "prefix_release": "with h as (select o_orderkey, o_orderstatus from orders order by o_orderkey limit 500) select o_orderstatus, count(*) as n, max(o_orderkey) as last from h group by o_orderstatus",
    "reject_reasons": f"with {_REASONS} select array_to_string(reasons, ',') as reasons, len(reasons) = 0 as accepted, count(*) as n, round(sum(l_quantity), 6) as quantity from j group by all",
    "reason_histogram": f"with {_REASONS}, e as (select l_suppkey, unnest(case when len(reasons) = 0 then ['accepted'] else reasons end) as outcome from j) select outcome, count(*) as n, count(distinct l_suppkey) as sources from e group by outcome",
    "gate_first_reason": f"with {_REASONS} select reasons[1] as reason, count(*) as n from j group by 1",
    "contract_violations": """select o_orderkey, 'price_positive' as rule from orders where not o_totalprice > 0 union all select o_orderkey, 'open_is_recent' from orders where not (o_orderstatus <> 'O' or o_orderdate >= timestamp '1995-01-01')
 union all select o_orderkey, 'urgent_is_dear' from orders where not (o_orderpriority <> '1-URGENT' or o_totalprice > 50000)""",
    "taxonomy_case": r"with t as (select lower(p_type) as a, 'lo' || p_size as b from part) select case when regexp_matches(a, '^helmet_|visitor') then 'human' when regexp_matches(a, '^lo(\d+|\b)|cart|\bbin|box|bucket|carried') then 'carried_object' else 'unknown_dynamic' end as kind, 'carried_object' as load, count(*) as n from t group by all",
    "parse_nulls": "select c_custkey, case when c_custkey % 7 > 2 then c_acctbal end as value from customer",
    "table_digest": """with r as (select sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) as h from orders), e as (select h, count(*) as c from r group by h),
 b as (select left(h, 2) as b, sha256(string_agg(h || ':' || c, ',' order by h || ':' || c)) as d, sum(c) as n from e group by 1)
select sha256(string_agg(d, ',' order by b)) as digest, cast(sum(n) as bigint) as n from b""",
    "json_flatten": "with e as (select event_type, unnest(json_keys(props)) as path, props from events) select event_type, path, count(*) as n, round(sum(cast(json_extract(props, '$.' || path) as double)), 6) as total from e group by all",
    "json_metrics": """with o as (select o_custkey, count(*) as n, round(max(o_totalprice), 2) as top, list_sort(list(o_orderkey)) as keys from orders group by 1),
 m as (select o_custkey, unnest([{'p': 'n', 'v': n::double}, {'p': 'price.max', 'v': top}, {'p': 'price.rounded.hundreds', 'v': floor(top / 100)}, {'p': 'ends.0.key', 'v': keys[1]::double}, {'p': 'ends.1.key', 'v': keys[-1]::double},
  {'p': 'first\\.three.0', 'v': keys[1]::double}, {'p': 'first\\.three.1', 'v': keys[2]::double}, {'p': 'first\\.three.2', 'v': keys[3]::double}]) as r from o)
select o_custkey, r.p as path, round(r.v, 6) as value from m where r.v is not null""",
    "signature_zscore": f"with {_Z} select vec_id, cast(feature as int) as feature, round(z, 6) as z from z",
    "soft_posterior": f"with {_Z}, y as (select *, vec_id // 16 as bank from z), s as (select a.bank, a.vec_id as i, b.vec_id as j, -sum((a.z - b.z) * (a.z - b.z)) / 50.0 as s from y a join y b on a.bank = b.bank and a.feature = b.feature group by all), w as (select *, exp(s - max(s) over (partition by bank, i)) as w from s) select bank, i, j, round(w / sum(w) over (partition by bank, i), 9) as p from w",
    "exact_posterior": "with d as (select vec_id, label, sha256(array_to_string(list_transform(embedding, lambda x: cast(floor(cast(x as double)) as int)), ',')) as digest from embeddings) select label, vec_id as i, count(*) over (partition by label, digest) as n, round(1.0 / count(*) over (partition by label, digest), 9) as p from d",
    "key_set_audit": "select r_name as experiment, case when r_name = 'ASIA' then 'extra' else 'both' end as state from region",
}
