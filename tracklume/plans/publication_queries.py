"""Publications of the given tables in the shared folder, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklume.sources import publish as P
from tracklume.sources.shared_tables import SharedTables
from tracklume.sources.tables import table


def _root(spark, name):
    return f"{SharedTables(spark, name).root}/out"


def published_manifest(spark, sf_dir):
    """Orders by status, published and verified: rows of each partition, and how many partitions differ from their manifest."""
    path = _root(spark, "published")
    said = P.publish(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"], ["o_orderkey", "o_totalprice"])
    broken = P.verify(spark, path, ["o_orderstatus"], ["o_orderkey", "o_totalprice"])
    return said.select("o_orderstatus", "rows").join(broken.groupBy("o_orderstatus").agg(F.count("*").alias("broken")), "o_orderstatus", "left").fillna(0, ["broken"])


def published_shards(spark, sf_dir):
    """Orders in ten shards by customer, of which three runs each take some and the last what is left: what the shards hold."""
    path = _root(spark, "shards")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 10).alias("shard"))
    for modulus, remainder in ((3, 0), (2, 1), (1, 0)):
        P.publish_shards(rows, path, "shard", modulus, remainder)
    return P.read_shards(spark, path, "shard").groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("price"))


def canonical_metrics(spark, sf_dir):
    """The metrics of every nation's customers as canonical JSON lines, in order."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.max("c_custkey").alias("last"), F.max(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name"))).alias("builder"))
    folder = P.publish_lines(rows, _root(spark, "lines"), ["nation"])
    return spark.read.text(folder)


QUERIES = {f.__name__: f for f in (published_manifest, published_shards, canonical_metrics)}
ORACLE = {
    "published_manifest": "select o_orderstatus, count(*) as rows, cast(0 as bigint) as broken from orders group by 1",
    "published_shards": "select cast(o_custkey % 10 as bigint) as shard, count(*) as n, count(distinct o_orderkey) as orders, round(sum(o_totalprice), 2) as price from orders group by 1",
    "canonical_metrics": """with m as (select c_nationkey as nation, count(*) as n, max(c_custkey) as last, max(c_name) filter (c_mktsegment = 'BUILDING') as builder from customer group by 1)
select '{"builder":' || coalesce('"' || builder || '"', 'null') || ',"last":' || last || ',"n":' || n || ',"nation":' || nation || '}' as value from m""",
}
