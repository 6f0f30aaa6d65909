"""op1: words of 13-word windows that an earlier document has too are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklume.llm.substring_dedup import remove_repeats


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLE = {
    "op1_substring_dedup": r"""
with words as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
 windows as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as s from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from words where len(w) >= 13)),
 firsts as (select s, min(doc_id) as owner from windows group by s),
 hits as (select doc_id, i from windows join firsts using (s) where doc_id > owner),
 gone as (select doc_id, list(distinct p) as ps from (select doc_id, unnest(generate_series(i, i + 12)) as p from hits) group by doc_id),
 kept as (select words.doc_id, len(w) as n_words, case when ps is null then w else list_transform(list_filter(generate_series(1, len(w)), lambda p: not list_contains(ps, p)), lambda p: w[p]) end as k
   from words left join gone on words.doc_id = gone.doc_id)
select doc_id, cast(n_words as bigint) as n_words, cast(n_words - len(k) as bigint) as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept"""
}
