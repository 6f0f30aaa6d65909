"""op10: every page as an archived response, and a later not-modified revisit of its URL.

Page p is fetched at 60 p seconds; the crawler comes back three days later and
the server answers 304 with the validators of the page it last saw.  Where
another page of the same canonical URL was archived in between, the latest
response is that one, and the validators tell whether it is the same page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklume.llm.warc import canonical_url, resolve_revisits

LATER = 3 * 86400


def records(pages: DataFrame) -> DataFrame:
    """A response and a revisit for every page; every other header field is of either kind that merging tells apart."""
    modified = (F.col("page_id") * 60 - F.length("html") % 1000).cast("string")
    etag = F.md5(F.col("html").cast("binary"))
    time = F.col("page_id") * 60
    pair = lambda *x: F.create_map(*(F.lit(v) if isinstance(v, str) else v for v in x))
    response = pair("etag", etag, "last-modified", modified, "content-type", "text/html", "date", time.cast("string"), "content-length", F.length("html").cast("string"))
    # Pages whose URL has a query came from a server without etags.
    checks = F.when(F.instr("url", "?") > 0, pair("last-modified", modified)).otherwise(pair("etag", etag))
    revisit = F.map_concat(checks, pair("date", (time + LATER).cast("string"), "cache-control", "max-age=600", "content-length", "0"))
    first = pages.select(F.col("page_id").alias("record_id"), F.lit("response").alias("type"), "url", time.alias("time"), response.alias("headers"))
    second = pages.select(F.col("page_id").alias("record_id"), F.lit("revisit").alias("type"), "url", (time + LATER).alias("time"), revisit.alias("headers"))
    return first.unionByName(second)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url_key, refers_to, status and the merged header fields of every page's revisit."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = resolve_revisits(records(pages))
    field = lambda name: F.element_at("headers", name).alias(name.replace("-", "_"))
    return found.select(F.col("record_id").alias("page_id"), "url_key", "refers_to", "status", *map(field, ("etag", "last-modified", "content-type", "date", "cache-control", "content-length")))


QUERIES = {"op10_warc": op10_warc}
ORACLE = {
    "op10_warc": rf"""
with bare as (select *, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '#[\s\S]*$', '') as b from pages),
 hosts as (select *, regexp_extract(b, '^[^/?]*', 0) as h from bare),
 keyed as (select page_id, html, url, regexp_replace(regexp_replace(lower(h), ':(80|443)$', ''), '^www\.', '')
   || regexp_replace(regexp_replace(substr(b, length(h) + 1), '([?&])(?:(?:utm_[a-z]+|gclid|fbclid|ref)=[^&]*(?:&|$))+', '\1', 'g'), '/?[?&]?$', '') as url_key from hosts),
 facts as (select page_id, url, url_key, page_id * 60 as t, md5(html) as tag, cast(page_id * 60 - length(html) % 1000 as varchar) as modified, length(html) as n from keyed),
 joined as (select v.page_id, v.url_key, v.url, v.t + {LATER} as rt, v.tag as vtag, v.modified as vmod, r.page_id as refers_to, r.tag as rtag, r.modified as rmod, r.n as rn,
   row_number() over (partition by v.page_id order by r.t desc, r.page_id desc) as k
   from facts v left join facts r on r.url_key = v.url_key and r.t < v.t + {LATER}),
 judged as (select *, case when refers_to is null then 'no_response' when instr(url, '?') > 0 then case when vmod = rmod then 'resolved' else 'mismatch' end
   else case when vtag = rtag then 'resolved' else 'mismatch' end end as status from joined where k = 1)
select page_id, url_key, refers_to, status,
 case when instr(url, '?') > 0 then case when status = 'resolved' then rtag end else vtag end as etag,
 case when instr(url, '?') > 0 then vmod else case when status = 'resolved' then rmod end end as last_modified,
 case when status = 'resolved' then 'text/html' end as content_type, cast(rt as varchar) as "date", 'max-age=600' as cache_control,
 case when status = 'resolved' then cast(rn as varchar) else '0' end as content_length from judged"""
}
