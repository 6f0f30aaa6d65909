"""Orders sealed in shards of 5,000 rows by their key, read back whole, in part and as a family of splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklume.sources import sealed as S
from tracklume.sources.shared_tables import SharedTables
from tracklume.sources.tables import table

SIZE = 5_000
_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


def _sealed(spark, rows, name):
    path = f"{SharedTables(spark, name).root}/table"
    return path, S.seal(rows, path, "o_orderkey", SIZE)


def sealed_shards(spark, sf_dir):
    """Of each shard: its rows and keys, by the manifest and by its rows."""
    path, said = _sealed(spark, table(spark, sf_dir, "orders").select(*_COLUMNS), "sealed-shards")
    rows = S.read_sealed(spark, path, expected=said["digest"])
    found = rows.groupBy("shard").agg(F.count("*").alias("n"), F.max("row_index").alias("last_index"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    told = S.shard_table(spark, path).select("shard", "rows", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    return told.join(found, "shard")


def sealed_range(spark, sf_dir):
    """Two columns of a tenth of the keys: shards out of range aren't opened, and other columns aren't read."""
    orders = table(spark, sf_dir, "orders").select(*_COLUMNS)
    path, _ = _sealed(spark, orders, "sealed-range")
    top = orders.agg(F.max("o_orderkey").alias("top"))
    low, high = (int(top.first()["top"] * x) for x in (0.4, 0.5))
    return S.read_sealed(spark, path, ["o_orderkey", "o_totalprice"], between=(low, high - 1))


def sealed_rows(spark, sf_dir):
    """A run of rows by their places, from the middle of one shard into another."""
    path, _ = _sealed(spark, table(spark, sf_dir, "orders").select(*_COLUMNS), "sealed-rows")
    return S.read_rows(spark, path, 700, SIZE, ["o_orderkey", "o_totalprice"])


def sealed_ids(spark, sf_dir):
    """The orders of a set of keys, each of which must be there: those of the urgent ones."""
    orders = table(spark, sf_dir, "orders")
    path, _ = _sealed(spark, orders.select(*_COLUMNS), "sealed-ids")
    return S.read_ids(spark, path, orders.where("o_orderpriority = '1-URGENT'"), "o_orderkey").select("o_orderkey", "o_totalprice", "shard")


def sealed_family(spark, sf_dir):
    """Line items in four sealed splits by order: ids that several rows have, and customers' orders of several splits."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_suppkey")
    paths, digests = {}, {}
    for i, split in enumerate(("calibration", "test", "train", "val")):
        paths[split], said = _sealed(spark, items.where(F.col("o_orderkey") % 4 == i), f"sealed-{split}")
        digests[split] = said["digest"]
    found = S.isolation(S.family(spark, paths, digests), ["o_orderkey", "l_linenumber"], "l_suppkey")
    return found


QUERIES = {f.__name__: f for f in (sealed_shards, sealed_range, sealed_rows, sealed_ids, sealed_family)}
_FAMILY = "family as (select l_orderkey, l_linenumber, l_suppkey, case l_orderkey % 4 when 0 then 'calibration' when 1 then 'test' when 2 then 'train' else 'val' end as split from lineitem)"
ORACLE = {
    "sealed_shards": f"""with placed as (select *, row_number() over (order by o_orderkey) - 1 as place from orders)
select place // {SIZE} as shard, count(*) as rows, min(o_orderkey) as first, max(o_orderkey) as last, count(*) as n, max(place % {SIZE}) as last_index, min(o_orderkey) as low, max(o_orderkey) as high, round(sum(o_totalprice), 2) as price from placed group by place // {SIZE}""",
    "sealed_range": "select o_orderkey, o_totalprice from orders, (select max(o_orderkey) as top from orders) where o_orderkey >= cast(floor(top * 0.4) as bigint) and o_orderkey < cast(floor(top * 0.5) as bigint)",
    "sealed_rows": f"select o_orderkey, o_totalprice from orders order by o_orderkey limit {SIZE} offset 700",
    "sealed_ids": f"with placed as (select *, (row_number() over (order by o_orderkey) - 1) // {SIZE} as shard from orders) select o_orderkey, o_totalprice, shard from placed where o_orderpriority = '1-URGENT'",
    "sealed_family": f"""with {_FAMILY} select 'repeated_id' as kind, l_orderkey || '/' || l_linenumber as value, count(*) as n, string_agg(distinct split, ',' order by split) as splits from family group by l_orderkey, l_linenumber having count(*) > 1
union all select 'shared_group', cast(l_suppkey as varchar), count(*), string_agg(distinct split, ',' order by split) from family group by l_suppkey having count(distinct split) > 1""",
}
