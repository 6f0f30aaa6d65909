"""op11: tokens of two tokenizers of every document, aligned."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracklume.llm import tokens
from tracklume.llm.alignment import Alignment, Encoder, Tokens, whole_texts

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def encoders() -> tuple[Encoder, Encoder]:
    """Side A encodes a space and the text; side B's model puts the space itself."""
    a, b = public_tokenizers.path(A), public_tokenizers.path(B)
    encode = tokens.byte_level(a, False)
    return (lambda x: encode(f" {x}"), tokens.byte_level_bytes(a)), (tokens.pieces(b), tokens.piece_bytes(b))


def by_parts(sides: tuple[Encoder, Encoder]) -> Callable[[list[str | None]], Tokens]:
    """The tokens of texts, of each part that recurs from a table."""
    if not tokens.divisible(public_tokenizers.path(B)):
        return whole_texts(sides)
    whole_a = tokens.byte_level(public_tokenizers.path(A), False)
    return tokens.Parts((whole_a, sides[0][1]), sides[1]).tokens


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return Alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), encoders, by_parts).summary()


QUERIES = {"op11_alignment": op11_alignment}
#: SQL has no tokenizers: tests hold the links against all pairs of tokens.
ORACLE: dict[str, str] = {}
