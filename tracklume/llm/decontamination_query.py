"""op3: documents that hold a passage of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklume.llm.decontamination import contaminated


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, cosine, common, answer: contaminated documents only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op3_decontamination": op3_decontamination}
#: SQL can't express the search: tests hold it against a brute-force comparison of all passages.
ORACLE: dict[str, str] = {}
