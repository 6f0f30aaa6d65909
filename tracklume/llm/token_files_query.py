"""op13: all documents' token ids in flat files, read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracklume.llm import tokens
from tracklume.llm.token_files import dataset, token_digests

TOKENIZER, VOCABULARY, END_ID = "byte_bpe_50k.json", 50_257, 2


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32."""
    path = public_tokenizers.path(TOKENIZER)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest, folder, scratch = dataset(docs, lambda: tokens.byte_level(path, True), VOCABULARY, END_ID)
    return scratch.keep(token_digests(manifest, folder), "digests")


QUERIES = {"op13_token_files": op13_token_files}
#: SQL has no tokenizer: tests hold the files against the tokenizer itself.
ORACLE: dict[str, str] = {}
