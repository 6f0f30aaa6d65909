"""op9: every document's bytes as an image, kept as an NPY tile and read back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracklume.llm.media import WIDTH, from_npy, text_tiles

_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tiles = [x.as_py() for x in batch.column(2)]
        payloads = [from_npy(x).tobytes() for x in tiles]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:2],
                pa.array(map(len, payloads), pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in payloads], pa.string()),
                pa.array([zlib.crc32(x[-WIDTH:]) for x in payloads], pa.int64()),
                pa.array(map(len, tiles), pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in tiles], pa.string()),
                batch.column(3),
            ],
            names=_NAMES,
        )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tiles = text_tiles(docs).select("doc_id", "n_bytes", "tile", "feature")
    return tiles.mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


QUERIES = {"op9_media": op9_media}
#: SQL has no images: tests hold the round trip against the texts.
ORACLE: dict[str, str] = {}
