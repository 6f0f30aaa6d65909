"""Sealed tables: shards of a fixed number of rows, each with its count, key range and column digests, under one manifest.

A table is a folder that driver and executors have mounted:

- ``shards/``: Arrow files, rows in order of ``row_index``;
- ``entries/``: for each complete shard one JSON line, which names its file;
- ``manifest.json``: the schema, all entries in order, and their digest.

Entries and the manifest are made by creating a link, which the file system
does once or not at all.  A task names its Arrow files anew at each attempt, so
a file that no entry names belongs to nothing; a run that broke off is taken up
by writing the shards without an entry.  Whatever a shard is read for, the
digests of the columns read are computed again, and a shard that differs stops
the query by its name.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tracklume.sources.shared_tables import SharedTables

#: Rows of an Arrow batch: what a reader holds of a shard at a time.
BATCH_ROWS = 8192
#: Rows of a partition that is read, about: small shards are read several by a task, as a task each costs more than its rows.
PARTITION_ROWS = 50_000


class SealError(ValueError):
    """A shard or manifest isn't what was sealed."""


class AlreadySealed(RuntimeError):
    """The table is complete."""


def local(path: str) -> str:
    """The path of a mounted folder."""
    found = path.removeprefix("file://").removeprefix("file:")
    if not found.startswith("/"):
        raise ValueError(f"sealed tables need a mounted folder, not {path}")
    return found.rstrip("/")


def canonical(value: object) -> str:
    """JSON of sorted keys without spaces or NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def create_once(path: str, text: str) -> bool:
    """Makes the file with all its text unless there is one already; whether this call made it.  Of many callers one makes it."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(draft, path)
    except FileExistsError:
        return False
    finally:
        os.remove(draft)
    return True


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=32).hexdigest()


class ColumnDigests:
    """BLAKE2b of each column, batch by batch: of its name, type and Arrow buffers."""

    def __init__(self, names: Iterable[str]):
        self.states = {x: hashlib.blake2b(x.encode(), digest_size=16) for x in names}

    def add(self, batch: pa.RecordBatch) -> None:
        for name, state in self.states.items():
            column = batch.column(batch.schema.get_field_index(name))
            state.update(f"{column.type}:{len(column)}".encode())
            state.update(pa.RecordBatch.from_arrays([column], names=[name]).serialize())

    def found(self) -> dict[str, str]:
        return {x: s.hexdigest() for x, s in self.states.items()}


def entries(path: str) -> list[dict]:
    """The entries of the complete shards, by shard."""
    place = f"{local(path)}/entries"
    found = []
    for name in os.listdir(place) if os.path.isdir(place) else []:
        if name.endswith(".json"):
            with open(f"{place}/{name}") as f:
                found.append(json.loads(f.read()))
    return sorted(found, key=lambda e: e["shard"])


def manifest(path: str, expected: str | None = None) -> dict:
    """The manifest, which must give its own digest, and ``expected`` where there is one."""
    try:
        with open(f"{local(path)}/manifest.json") as f:
            found = json.loads(f.read())
    except FileNotFoundError:
        raise SealError(f"{path} has no manifest: it isn't complete") from None
    if found.get("digest") != digest(canonical(found["shards"])):
        raise SealError(f"the manifest of {path} doesn't give its own digest")
    if expected and found["digest"] != expected:
        raise SealError(f"the manifest of {path} is {found['digest']}, not {expected}")
    return found


class _Shards(InputPartition):
    def __init__(self, entries: list[dict]):
        self.entries = entries


def runs(entries: list[dict], rows: int = PARTITION_ROWS) -> list[list[dict]]:
    """The entries in order, in runs of at most ``rows`` rows or of one shard."""
    out, held = [], 0
    for entry in entries:
        if not out or held + entry["rows"] > rows:
            out.append([])
            held = 0
        out[-1].append(entry)
        held += entry["rows"]
    return out


class _Written(WriterCommitMessage):
    def __init__(self, shards: list[int]):
        self.shards = shards


def goes_on(index: pa.Array, first: int) -> bool:
    """Whether these are the numbers from ``first`` on."""
    return index.null_count == 0 and np.array_equal(index.to_numpy(zero_copy_only=False), np.arange(first, first + len(index)))


def check_batches(name: str, entry: dict, batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches, once it is known that they are the entry's: rows, order and the digests of ``columns``."""
    digests, rows = ColumnDigests(columns), 0
    for batch in batches:
        if "row_index" in columns:
            index = batch.column(batch.schema.get_field_index("row_index"))
            if not goes_on(index, rows):
                raise SealError(f"{name}: row_index doesn't go on from {rows}")
        digests.add(batch)
        rows += batch.num_rows
        yield batch
    if rows != entry["rows"]:
        raise SealError(f"{name}: {rows} rows, not {entry['rows']}")
    wrong = [x for x, d in digests.found().items() if entry["columns"][x] != d]
    if wrong:
        raise SealError(f"{name}: other contents in {', '.join(sorted(wrong))}")


class SealedReader(DataSourceReader):
    """A partition a run of shards, without the shards whose keys lie outside ``between``, or whose numbers outside ``only``."""

    def __init__(self, path: str, schema: StructType, expected: str | None, between: tuple | None, only: tuple | None = None):
        self.path, self.names = path, schema.fieldNames()
        low, high = between or (None, None)
        first, last = only or (0, float("inf"))
        out = lambda e: e["first"] is not None and ((low is not None and e["last"] < low) or (high is not None and e["first"] > high))
        self.entries = [e for e in manifest(path, expected)["shards"] if not out(e) and first <= e["shard"] <= last]

    def partitions(self) -> list[_Shards]:
        return [_Shards(x) for x in runs(self.entries)]

    def read(self, partition: _Shards) -> Iterator[pa.RecordBatch]:
        for entry in getattr(partition, "entries", ()):  # none where no shard is left
            yield from self._read(entry)

    def _read(self, entry: dict) -> Iterator[pa.RecordBatch]:
        name = f"shard {entry['shard']} of {self.path}"
        try:
            with pa.memory_map(f"{local(self.path)}/shards/{entry['file']}") as held:
                wide = pa.ipc.open_file(held).schema
                if missing := [x for x in self.names if x not in wide.names]:
                    raise SealError(f"{name}: no column {', '.join(missing)}")
                options = pa.ipc.IpcReadOptions(included_fields=[wide.get_field_index(x) for x in self.names])
                file = pa.ipc.open_file(held, options=options)
                # A first pass checks, so that no row of a broken shard is seen.
                for _ in check_batches(name, entry, (file.get_batch(i) for i in range(file.num_record_batches)), self.names):
                    pass
                for i in range(file.num_record_batches):
                    yield file.get_batch(i).select(self.names)
        except (OSError, pa.ArrowInvalid) as error:
            raise SealError(f"{name}: {error}") from None


class SealedWriter(DataSourceArrowWriter):
    """Writes rows that come by shard and row_index; see ``seal``."""

    def __init__(self, path: str, key: str, size: int):
        self.path, self.key, self.size = path, key, size

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        place, done, held = local(self.path), [], []
        os.makedirs(f"{place}/shards", exist_ok=True)
        for batch in iterator:
            shards = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            ends = [*(np.flatnonzero(np.diff(shards)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            at = 0
            for to in ends:
                shard = int(shards[at])
                if held and held[0][0] != shard:
                    done.append(self._finish(*held.pop()))
                if not held:
                    file = f"{shard:06d}-{uuid.uuid4().hex}.arrow"
                    held.append((shard, file, pa.OSFile(f"{place}/shards/{file}", "wb"), []))
                    held[0][3].append(pa.ipc.new_file(held[0][2], batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")))
                for cut in range(at, to, BATCH_ROWS):
                    held[0][3][0].write_batch(batch.slice(cut, min(BATCH_ROWS, to - cut)))
                at = to
        if held:
            done.append(self._finish(*held.pop()))
        return _Written(done)

    def _finish(self, shard: int, file: str, out: pa.NativeFile, writers: list) -> int:
        """Reads the file back for its digests, and makes the entry."""
        writers[0].close()
        out.close()
        place = local(self.path)
        with pa.memory_map(f"{place}/shards/{file}") as held:
            read = pa.ipc.open_file(held)
            digests, rows, first, last = ColumnDigests(read.schema.names), 0, None, None
            for i in range(read.num_record_batches):
                batch = read.get_batch(i)
                index = batch.column(batch.schema.get_field_index("row_index"))
                if not goes_on(index, rows):
                    raise SealError(f"shard {shard}: row_index doesn't go on from {rows}")
                keys = batch.column(batch.schema.get_field_index(self.key))
                known = keys.drop_null()
                low, high = (known[0].as_py(), known[-1].as_py()) if len(known) else (None, None)
                first, last, rows = low if first is None else first, high if high is not None else last, rows + len(index)
                if keys.null_count:
                    first = last = None  # a range says nothing about null keys: the shard is always read
                digests.add(batch)
        if rows > self.size:
            raise SealError(f"shard {shard}: {rows} rows, more than {self.size}")
        entry = {"shard": shard, "file": file, "rows": rows, "first": first, "last": last, "columns": digests.found()}
        if not create_once(f"{place}/entries/{shard:06d}.json", canonical(entry)):
            os.remove(f"{place}/shards/{file}")  # another attempt was first
        return shard

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        pass  # the manifest follows when all shards are there

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        pass  # complete shards stay for the next run


class SealedSource(DataSource):
    """``spark.read.format("sealed")``; options path, columns (comma-separated; all if left out), digest (of the manifest), between (a JSON list: the least and the greatest key, or null) and shards (a JSON list: the first and the last)."""

    @classmethod
    def name(cls) -> str:
        return "sealed"

    def schema(self) -> StructType:
        whole = StructType.fromJson(manifest(self.options["path"])["schema"])
        wanted = self.options.get("columns")
        return StructType([whole[x] for x in wanted.split(",")]) if wanted else whole

    def reader(self, schema: StructType) -> SealedReader:
        return SealedReader(self.options["path"], schema, self.options.get("digest"), json.loads(self.options.get("between", "null")), json.loads(self.options.get("shards", "null")))

    def writer(self, schema: StructType, overwrite: bool) -> SealedWriter:
        return SealedWriter(self.options["path"], self.options["key"], int(self.options["size"]))


def sharded(rows: DataFrame, key: str, size: int, tables: SharedTables) -> DataFrame:
    """``rows`` in order of ``key`` with ``shard`` and ``row_index``: ``size`` rows a shard, the last one takes what is left; null keys come first.

    A row's place in the whole is its place in a range of keys and the number
    of rows in the ranges before: what a single task sees is a count a range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key).asc_nulls_first(), F.col("_tie")]
    ranged = rows.withColumn("_tie", F.xxhash64(*rows.columns)).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    ranged = tables.write(ranged, "ranged")  # ranges are sampled: counts and rows must see the same ones
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_ahead"))
    placed = ranged.join(F.broadcast(ahead), "_range").withColumn("_at", F.col("_ahead") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    return placed.select(*rows.columns, F.floor(F.col("_at") / size).alias("shard"), (F.col("_at") % size).alias("row_index"))


def seal(rows: DataFrame, path: str, key: str, size: int) -> dict:
    """Writes ``rows`` to ``path`` as shards of ``size`` rows in order of ``key``, and the manifest, which is returned.

    A complete table is left as it is (AlreadySealed); of one that broke off
    only the missing shards are written, all by one job.  Columns named shard
    or row_index are replaced.  An empty table has a manifest without shards.
    """
    spark, place = rows.sparkSession, local(path)
    if os.path.exists(f"{place}/manifest.json"):
        raise AlreadySealed(path)
    spark.dataSource.register(SealedSource)
    tables = SharedTables(spark, "sealing")
    found = sharded(rows.drop("shard", "row_index"), key, size, tables)
    there = [e["shard"] for e in entries(path)]
    missing = found.where(~F.col("shard").isin(there)) if there else found
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    missing.repartition(n, "shard").sortWithinPartitions("shard", "row_index").write.format("sealed").mode("append").options(path=path, key=key, size=size).save()
    total = found.agg(F.count("*")).first()[0]
    tables.drop("ranged")
    made, shards = entries(path), -(-total // size)
    sizes = [size] * (shards - 1) + [total - size * (shards - 1)] if shards else []
    if [(e["shard"], e["rows"]) for e in made] != list(enumerate(sizes)):
        raise SealError(f"{path}: shards are missing or short")
    said = {"schema": json.loads(found.schema.json()), "key": key, "size": size, "rows": total, "shards": made, "digest": digest(canonical(made))}
    if not create_once(f"{place}/manifest.json", canonical(said)):
        raise AlreadySealed(path)
    return said


def read_sealed(spark: SparkSession, path: str, columns: list[str] | None = None, expected: str | None = None, between: tuple | None = None) -> DataFrame:
    """A sealed table, or only some columns of it; ``expected`` is the digest its manifest must have.

    ``between`` is the least and the greatest key wanted (either may be None):
    shards outside are not opened, and rows outside, null keys among them, go.
    """
    spark.dataSource.register(SealedSource)
    options = {"path": path} | ({"columns": ",".join(columns)} if columns else {}) | ({"digest": expected} if expected else {})
    if between is None:
        return spark.read.format("sealed").options(**options).load()
    key, (low, high) = manifest(path)["key"], between
    found = spark.read.format("sealed").options(**options, between=json.dumps(between)).load()
    found = found if low is None else found.where(F.col(key) >= low)
    return found if high is None else found.where(F.col(key) <= high)


def read_rows(spark: SparkSession, path: str, start: int, count: int, columns: list[str] | None = None) -> DataFrame:
    """``count`` rows from the ``start``-th on (from 0) in order of the key, or those that there are; only their shards are opened."""
    spark.dataSource.register(SealedSource)
    size = manifest(path)["size"]
    wanted = None if columns is None else [*columns, *(c for c in ("shard", "row_index") if c not in columns)]
    options = {"path": path, "shards": json.dumps([start // size, (start + count - 1) // size])} | ({"columns": ",".join(wanted)} if wanted else {})
    at = F.col("shard") * size + F.col("row_index")
    found = spark.read.format("sealed").options(**options).load().where((at >= start) & (at < start + count))
    return found if columns is None else found.select(*columns)


def read_ids(spark: SparkSession, path: str, ids: DataFrame, id_: str) -> DataFrame:
    """The rows of a set of keys (column ``id_``); a key without a row stops the job by its name.  Shards outside the set's range aren't opened."""
    key = manifest(path)["key"]
    wanted = ids.where(F.col(id_).isNotNull()).select(F.col(id_).alias("_wanted")).distinct()
    low, high = wanted.agg(F.min("_wanted"), F.max("_wanted")).first()
    rows = read_sealed(spark, path, between=(low, high)).withColumn("_there", F.lit(True))
    met = wanted.join(rows, F.col("_wanted") == F.col(key), "left")
    lost = F.raise_error(F.concat(F.lit("no row for "), F.col("_wanted").cast("string")))
    return met.where(F.when(F.col("_there").isNotNull(), F.lit(True)).otherwise(lost)).drop("_wanted", "_there")


def shard_table(spark: SparkSession, path: str) -> DataFrame:
    """What the manifest says of each shard, without a look at the shards: shard, rows, first and last key as text, file and a digest of its columns."""
    rows = [(e["shard"], e["rows"], *(None if e[k] is None else str(e[k]) for k in ("first", "last")), e["file"], digest(canonical(e["columns"]))) for e in manifest(path)["shards"]]
    return spark.createDataFrame(rows, "shard long, rows long, first string, last string, file string, digest string")


def family(spark: SparkSession, members: dict[str, str], expected: dict[str, str] | None = None) -> DataFrame:
    """Sealed tables of the same columns, one a split, as one with ``split``; ``expected`` has the digest that each manifest must have."""
    if expected is not None and set(expected) != set(members):
        raise SealError(f"members {sorted(members)}, but digests of {sorted(expected)}")
    parts = [read_sealed(spark, path, expected=(expected or {}).get(split)).withColumn("split", F.lit(split)) for split, path in sorted(members.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def isolation(rows: DataFrame, ids: list[str], group: str) -> DataFrame:
    """What breaks a family: ``kind`` repeated_id (ids that several rows have) or shared_group (groups of several splits), ``value``, ``n`` and ``splits``.  Null groups are none."""
    splits = F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits")
    again = rows.groupBy(F.concat_ws("/", *(F.col(c).cast("string") for c in ids)).alias("value")).agg(F.count("*").alias("n"), splits).where("n > 1")
    shared = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("value")).agg(F.count("*").alias("n"), splits).where(F.col("splits").contains(","))
    return again.select(F.lit("repeated_id").alias("kind"), "value", "n", "splits").union(shared.select(F.lit("shared_group").alias("kind"), "value", "n", "splits"))


def forget(path: str) -> None:
    """Deletes a sealed table that nothing reads any more; the manifest goes first."""
    place = local(path)
    with contextlib.suppress(FileNotFoundError):
        os.remove(f"{place}/manifest.json")
    for folder in ("entries", "shards"):
        for name in os.listdir(f"{place}/{folder}") if os.path.isdir(f"{place}/{folder}") else []:
            os.remove(f"{place}/{folder}/{name}")
