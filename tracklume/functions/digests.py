"""Digests and ids: BLAKE2b of parts in Arrow batches, and digests of whole tables by a tree of SHA-256."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries that are fed to a leaf's hash at once, and hex digits of a leaf's prefix.
LEAF_ROWS, DIGITS = 1024, 2


def joined(*parts: Column) -> Column:
    """The parts as text, joined by ``|``; nulls are empty, so that a place is never lost."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def blake2b(text: Column, size: int = 16) -> Column:
    """2 * size hex digits of BLAKE2b over UTF-8; null for null."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else hashlib.blake2b(v.encode(), digest_size=size).hexdigest() for v in values.to_pylist()], pa.string())

    return run(text)


def stable_digest(*parts: Column, size: int = 16) -> Column:
    return blake2b(joined(*parts), size)


def derive_seed(base: int, *parts: Column) -> Column:
    """An unsigned 32-bit number of a base seed and the parts: the last four of eight bytes of BLAKE2b."""
    return F.conv(F.substring(blake2b(joined(F.lit(f"seed={base}"), *parts), 8), 9, 8), 16, 10).cast("long")


def sample_id(split: Column, *parts: Column) -> Column:
    """``split``, a dash, and 24 digits that stand for it and the parts."""
    return F.concat_ws("-", split, stable_digest(split, *parts, size=12))


def row_text(columns: list[Column]) -> Column:
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("~")) for c in columns))


def table_digest(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """``digest`` and ``n`` of a table, whatever its order, size and partitions: a tree over the SHA-256 digests of its rows.

    Equal rows are one entry, ``digest:count``, so that frequent ones don't
    gather.  A leaf is the SHA-256 of the sorted entries of one of 256
    prefixes, joined by commas; the digest is that of the leaves' in order.
    Spark sorts the entries, and a leaf's hash is fed as they pass by, so no
    leaf is ever held.  An empty table has the digest of the empty string.
    """
    hashed = rows.select(F.sha2(row_text(columns), 256).alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    entries = hashed.select(F.substring("h", 1, DIGITS).alias("b"), F.concat_ws(":", "h", F.col("c").cast("string")).alias("e"), "c")
    leaves = entries.repartition("b").sortWithinPartitions("b", "e").mapInArrow(_leaves, "b string, d string, n long")
    top = leaves.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ","), 256).alias("digest"), F.sum("n").alias("n"))
    return top.select("digest", F.coalesce("n", F.lit(0)).alias("n"))


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, digest, rows) of each prefix of a partition whose entries come in order."""
    leaf, digest, n, found = None, None, 0, []
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        for b, run in groupby(rows, lambda r: r[0]):
            if b != leaf:
                if digest:
                    found.append((leaf, digest.hexdigest(), n))
                leaf, digest, n = b, hashlib.sha256(), 0
            while part := list(islice(run, LEAF_ROWS)):
                digest.update(("," if n else "").encode() + ",".join(e for _, e, _ in part).encode())
                n += sum(c for _, _, c in part)
    if digest:
        found.append((leaf, digest.hexdigest(), n))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["b", "d", "n"])
