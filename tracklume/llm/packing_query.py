"""op6: all documents packed into sequences of 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracklume.llm.packing import packed_pieces

CAPACITY = 2048
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def pack_documents(docs: DataFrame) -> DataFrame:
    return packed_pieces(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), CAPACITY)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_packing": op6_packing}
#: SQL has no tokenizer: tests hold the result against the tokenizer and the bounds of the sequences.
ORACLE: dict[str, str] = {}
