"""Token ids as flat files of unsigned integers, with 64-bit document offsets beside them.

A dataset is a folder of parts and a manifest, a table of one row a part.  A
part is two files: ``.ids``, the ids of its documents one after the other as
little-endian unsigned integers of the manifest's width, and ``.docs``, for
each document its doc_id and the offset of its first id in the part, and one
offset more: the end (little-endian 64-bit integers, ids first).  Parts hold
ascending ranges of doc_ids, null ones first.

No offset of a part depends on another part: a part's base, the number of ids
before it, is a prefix sum over the manifest.  So parts are written in one pass
by independent tasks.  A task names its files anew at each attempt, and the
manifest holds those of the attempt that Spark committed: what a lost executor
left behind belongs to no dataset.
"""

from __future__ import annotations

import itertools
import mmap
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklume.llm import text as T
from tracklume.llm.scratch import Scratch, partitions

MANIFEST = "part long, name string, width int, docs long, nulls long, ids long"
#: Ids that a reader holds at a time, about; a longer document stands alone.
READ_IDS = 1 << 20


def local_path(folder: str) -> str:
    """The path of a folder that all workers have mounted; other stores can't be mapped into memory."""
    path = folder.removeprefix("file://").removeprefix("file:")
    if not path.startswith("/"):
        raise ValueError(f"token files need a mounted folder, not {folder}")
    return path


def width(vocabulary: int) -> int:
    """Bytes of the narrowest unsigned integer that holds all ids below ``vocabulary``."""
    return next(w for w in (1, 2, 4, 8) if vocabulary <= 1 << (8 * w))


def mapped(path: str, dtype: str) -> np.ndarray:
    """A file's integers, without reading what isn't asked for."""
    with open(path, "rb") as f:
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype) if os.fstat(f.fileno()).st_size else np.zeros(0, dtype)


class Part(NamedTuple):
    """ids: all of the part's, mapped; doc_ids, with ``nulls`` null ones at the front; offsets: one more than documents."""

    ids: np.ndarray
    doc_ids: np.ndarray
    offsets: np.ndarray


def open_part(folder: str, name: str, width_: int, docs: int) -> Part:
    numbers = mapped(f"{folder}/{name}.docs", "<i8")
    return Part(mapped(f"{folder}/{name}.ids", f"<u{width_}"), numbers[:docs], numbers[docs:])


def write_token_files(docs: DataFrame, folder: str, encoder: Callable[[], Callable[[str], list[int]]], vocabulary: int, end_id: int | None) -> DataFrame:
    """Writes the ids of every whole text of ``docs`` (doc_id, text) to ``folder``, in ascending doc_id order; the manifest, not yet run.

    ``encoder`` gives, on a worker, the function from a text to its ids, all
    below ``vocabulary``; ``end_id``, if there is one, ends each document.  A
    null text is an empty one.  Null doc_ids come first; rows of equal doc_ids
    each have a place, in the order of their texts.  An empty table gives
    parts without documents.  Columns other than these two are not read.
    """
    size, place = width(vocabulary), local_path(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        os.makedirs(place, exist_ok=True)
        ids_end, count, nulls = 0, 0, 0
        # Numbers of all documents, 16 bytes each, are kept beside the ids in the file system, not in memory.
        with open(f"{place}/{name}.ids", "wb") as ids_file, open(f"{place}/{name}.docs", "w+b") as docs_file, open(f"{place}/{name}.offsets", "w+b") as offsets_file:
            for batch in T.chunks(batches):
                doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
                found = [encode(x or "") for x in texts]
                if end_id is not None:
                    for x in found:
                        x.append(end_id)
                lengths = np.fromiter(map(len, found), np.int64, len(found))
                ids_file.write(np.concatenate([np.array(x, f"<u{size}") for x in found]).tobytes())
                offsets_file.write((ids_end + np.cumsum(lengths) - lengths).astype("<i8").tobytes())
                docs_file.write(doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes())
                ids_end, count, nulls = ids_end + int(lengths.sum()), count + len(found), nulls + doc_ids.null_count
            offsets_file.write(np.array([ids_end], "<i8").tobytes())
            offsets_file.seek(0)
            while piece := offsets_file.read(1 << 20):
                docs_file.write(piece)
        os.remove(f"{place}/{name}.offsets")
        values = (part, name, size, count, nulls, ids_end)
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Copies of one doc_id can't all be cut into one range: their texts, by hash, are part of the key.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text").mapInArrow(write, MANIFEST)


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the number of ids in all parts before; it has one row a part, however large the parts are."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _lists(spans: list[np.ndarray]) -> list[pa.Array]:
    ends = np.cumsum([0, *map(len, spans)])
    return [pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(spans).astype(np.int64))).cast(pa.list_(pa.int64()))]


def _digests(spans: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(map(len, spans), pa.int64()), pa.array((zlib.crc32(x.astype("<u4")) for x in spans), pa.int64())]


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ``ids``, from the files that a written ``manifest`` names."""
    return _read(manifest, folder, "ids array<long>", _lists)


def token_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the crc32 of the ids as little-endian unsigned 32-bit integers, from the files."""
    return _read(manifest, folder, "n_tokens long, ids_crc32 long", _digests)


def _read(manifest: DataFrame, folder: str, schema: str, columns: Callable[[list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    place, count = local_path(folder), partitions(manifest.sparkSession)
    names = ["doc_id", "start", *(x.split()[0] for x in schema.split(", "))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            part, at = open_part(place, row["name"], row["width"], row["docs"]), 0
            while at < row["docs"]:
                to = int(np.searchsorted(part.offsets, part.offsets[at] + READ_IDS, "right")) - 1
                to = min(max(at + 1, to), row["docs"], at + 10_000)
                bounds = part.offsets[at : to + 1].tolist()
                spans = [part.ids[a:b] for a, b in itertools.pairwise(bounds)]
                doc_ids = pa.array(part.doc_ids[at:to], mask=np.arange(at, to) < row["nulls"])
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(part.offsets[at:to] + row["base"]), *columns(spans)], names=names)
                at = to

    return with_bases(manifest).repartitionByRange(count, "part").mapInArrow(read, f"doc_id long, start long, {schema}")


def dataset(docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], vocabulary: int, end_id: int | None) -> tuple[DataFrame, str, Scratch]:
    """The written manifest and the folder of a job's own token files, and the scratch that holds both."""
    scratch = Scratch(docs.sparkSession, "token-files")
    folder = f"{scratch.root}/files"
    return scratch.write(write_token_files(docs, folder, encoder, vocabulary, end_id), "manifest"), folder, scratch
