"""op5: components of documents whose 4-word shingles reach a Jaccard similarity of 0.85."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklume.llm.jaccard_join import jaccard_components

SHINGLE, PERCENT = 4, 85


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHINGLE, PERCENT)


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLE = {
    "op5_jaccard_join": r"""
with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
 shingles as (select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i : i + 3], ' ') end as s
   from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) as i from words where len(w) > 0)),
 sizes as (select doc_id, count(*) as n from shingles group by doc_id),
 pairs as (select a.doc_id as x, b.doc_id as y, count(*) as common from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
 links as (select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * common >= 85 * (p.n + q.n - common)),
 sides as (select x, y from links union all select y, x from links),
 reach as (select doc_id as node, doc_id as label from documents union select x, label from reach join sides on y = node),
 least as (select node, min(label) as component_id from reach group by node)
select words.doc_id, coalesce(n, 0) as n_shingles, component_id from words left join sizes using (doc_id) join least on node = words.doc_id"""
}
