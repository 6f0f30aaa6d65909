"""op12: every damaged conversation, mended by the cheapest edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklume.llm.conversations import damaged, repairs


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return repairs(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {"op12_conversations": op12_conversations}
#: SQL has no priority queue: tests hold the repairs against all edits of short conversations, and long ones against a table of all nodes.
ORACLE: dict[str, str] = {}
