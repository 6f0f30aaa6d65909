"""Publication of tables: committed once by whoever comes first, with a manifest of what each partition holds, and resumable by shard.

Data are written to a folder of the run; what makes them public is a small
file that names it.  That file is made by an operation that fails if it is
there already: a link on a mounted folder, elsewhere a create without
overwriting.  So of two writers one publishes and the other is told, and
neither sees half of the other's data.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklume.functions.digests import row_text
from tracklume.sources.sealed import create_once


class AlreadyPublished(RuntimeError):
    """Something is published at this path."""


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes the file with this text unless there is one; whether this call made it."""
    place, fs = _place(spark, path)
    plain = place.toUri()
    if plain.getScheme() in (None, "file") and fs.getScheme() == "file":
        return create_once(plain.getPath(), text)
    try:
        out = fs.create(place, False)
    except Exception as error:
        if fs.exists(place):
            return False
        raise error
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _told(spark: SparkSession, folder: str) -> dict[str, dict]:
    """The commits of a folder: from name to contents."""
    place, fs = _place(spark, folder)
    if not fs.exists(place):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().endswith(".json")]
    if not names:
        return {}
    rows = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.input_file_name().alias("file"), "value").collect()  # a few bytes a shard
    return {r.file.rpartition("/")[2].removesuffix(".json"): json.loads(r.value) for r in rows}


def manifest(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Per partition: rows, and a digest of them in any order (the sum and the xor of row hashes)."""
    each = F.xxhash64(row_text([F.col(c) for c in columns]))
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.bit_xor(each).alias("xor"), F.sum(F.pmod(each, F.lit(1 << 31))).alias("sum"))


def publish(rows: DataFrame, path: str, by: list[str], columns: list[str]) -> DataFrame:
    """Writes data by partition and their manifest to a folder of this run below ``path``, and publishes it; returns the manifest.

    A path where something is published is left as it is (AlreadyPublished),
    also if another writer comes first while this one writes: its folder then
    belongs to nothing and is deleted.
    """
    spark = rows.sparkSession
    if "published" in _told(spark, f"{path}/commits"):
        raise AlreadyPublished(path)
    run = f"run-{uuid.uuid4().hex}"
    rows.repartition(*by).write.partitionBy(*by).parquet(f"{path}/{run}/data")
    manifest(spark.read.parquet(f"{path}/{run}/data"), by, columns).write.parquet(f"{path}/{run}/manifest")
    if not commit_once(spark, f"{path}/commits/published.json", json.dumps({"run": run})):
        place, fs = _place(spark, f"{path}/{run}")
        fs.delete(place, True)
        raise AlreadyPublished(path)
    return spark.read.parquet(f"{path}/{run}/manifest")


def published(spark: SparkSession, path: str) -> str:
    """The folder that is published at ``path``."""
    return f"{path}/{_told(spark, f'{path}/commits')['published']['run']}"


def verify(spark: SparkSession, path: str, by: list[str], columns: list[str]) -> DataFrame:
    """Partitions whose data no longer give their manifest's row; none if all is well."""
    run = published(spark, path)
    said, found = spark.read.parquet(f"{run}/manifest"), manifest(spark.read.parquet(f"{run}/data"), by, columns)
    return found.exceptAll(said).union(said.exceptAll(found))


def publish_shards(rows: DataFrame, path: str, shard: str, modulus: int = 1, remainder: int = 0) -> list[int]:
    """Writes the shards of ``shard`` mod ``modulus`` that aren't committed yet, all by one write, and commits each; gives those that this run committed.

    Several drivers can share the work by remainders, or race for it: a shard
    is what its first commit names.  A repeated run writes nothing again.
    """
    spark = rows.sparkSession
    done = [int(x) for x in _told(spark, f"{path}/commits")]
    todo = rows.where((F.pmod(F.col(shard), F.lit(modulus)) == remainder) & ~F.col(shard).isin(done))
    run = f"run-{uuid.uuid4().hex}"
    todo.repartition(shard).write.partitionBy(shard).parquet(f"{path}/{run}")
    place, fs = _place(spark, f"{path}/{run}")
    made = sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(place) if s.isDirectory() and "=" in s.getPath().getName() and s.getPath().getName().partition("=")[2].lstrip("-").isdigit())
    return [s for s in made if commit_once(spark, f"{path}/commits/{s}.json", json.dumps({"run": run}))]


def read_shards(spark: SparkSession, path: str, shard: str) -> DataFrame:
    """The committed shards as one table."""
    folders = [f"{path}/{c['run']}/{shard}={s}" for s, c in sorted(_told(spark, f"{path}/commits").items())]
    parts: dict[str, list[str]] = {}
    for f in folders:
        parts.setdefault(f.rpartition("/")[0], []).append(f)
    frames = [spark.read.option("basePath", base).parquet(*some) for base, some in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def canonical_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """``value``: a row as a JSON line of sorted keys, nulls written out, in the order of ``order``.

    NaN and infinities have no JSON: a row that holds one stops the job, with the row's keys in the message.
    """
    bad = [F.col(f.name).isNotNull() & (F.isnan(f.name) | (F.abs(f.name) == float("inf"))) for f in rows.schema.fields if f.dataType.typeName() in ("double", "float")]
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    broken = F.lit(False)
    for b in bad:
        broken = broken | b
    message = F.concat(F.lit("no JSON for the row "), F.to_json(F.struct(*order)))
    return rows.orderBy(*order).select(F.when(broken, F.raise_error(message)).otherwise(text).alias("value"))


def publish_lines(rows: DataFrame, path: str, order: list[str]) -> str:
    """Canonical JSON lines of ``rows``, in files whose names are in their order, published once; gives the folder."""
    spark = rows.sparkSession
    if "published" in _told(spark, f"{path}/commits"):
        raise AlreadyPublished(path)
    run = f"run-{uuid.uuid4().hex}"
    canonical_lines(rows, order).write.text(f"{path}/{run}/lines")
    if not commit_once(spark, f"{path}/commits/published.json", json.dumps({"run": run})):
        raise AlreadyPublished(path)
    return f"{path}/{run}/lines"
