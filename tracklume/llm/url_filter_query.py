"""op7: the verdict on every page's URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklume.llm.url_filter import RULES, url_verdicts


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict; a URL that no rule fits is not in the block list, so allowed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_verdicts(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in RULES)
ORACLE = {
    "op7_url_filter": rf"""
with rules(verdict, rule_host, rule_path) as (values {_RULES}),
 rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as tail from pages),
 parts as (select page_id, regexp_extract(tail, '(?s)^[^/?#]*', 0) as raw, tail from rest),
 cut as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
   regexp_extract(substr(tail, length(raw) + 1), '(?s)^[^?#]*', 0) as path from parts),
 fits as (select page_id, rule_host || rule_path as rule, verdict, row_number() over (partition by page_id order by length(rule_host || rule_path) desc) as place
   from cut join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select cut.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from cut left join fits on cut.page_id = fits.page_id and place = 1"""
}
QUERIES = {"op7_url_filter": op7_url_filter}
