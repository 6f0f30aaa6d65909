"""op4: all documents in 40 contiguous shards of near-equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklume.llm.sharding import byte_shards

SHARDS = 40


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    keys = docs.select("doc_id", F.octet_length(text).alias("octets"), F.crc32(text).alias("text_crc32"))
    placed = byte_shards(keys, "doc_id", F.col("octets") + 16, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op4_sharding": op4_sharding}
#: DuckDB has no crc32 of strings: tests hold the result against a brute-force version.
ORACLE: dict[str, str] = {}
