"""A stream over a sealed table in epochs, whose offset is a cursor: epoch, place of the shard in the epoch's order, row.

In each epoch shards come in the order of a digest of (seed, epoch, shard), and
a shard's rows in that of (seed, epoch, key).  A trigger takes ``rows`` rows
on; the cursor is in the query's checkpoint, so a run that was stopped goes on
at the next row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructType

from tracklume.sources.sealed import SealError, check_batches, local, manifest

Cursor = dict[str, int]


def _order(seed: str, epoch: int, value: object) -> str:
    return hashlib.sha256(f"{seed}|{epoch}|{value}".encode()).hexdigest()


class _Span(InputPartition):
    """Rows ``first`` to ``stop`` of a shard in an epoch's order; ``base`` is the number of the epoch's rows in shards before."""

    def __init__(self, epoch: int, entry: dict, base: int, first: int, stop: int):
        self.epoch, self.entry, self.base, self.first, self.stop = epoch, entry, base, first, stop


class EpochReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        said = manifest(options["path"], options.get("digest"))
        self.path, self.key, self.shards = options["path"], said["key"], [e for e in said["shards"] if e["rows"]]
        self.seed, self.epochs, self.rows = options["seed"], int(options["epochs"]), int(options["rows"])
        self.at: Cursor | None = None
        self.orders: dict[int, list[dict]] = {}

    def order(self, epoch: int) -> list[dict]:
        if epoch not in self.orders:
            self.orders = {epoch: sorted(self.shards, key=lambda e: (_order(self.seed, epoch, e["shard"]), e["shard"]))}
        return self.orders[epoch]

    def initialOffset(self) -> Cursor:
        return {"epoch": 0, "shard": 0, "row": 0}

    def spans(self, start: Cursor, rows: int | None = None, end: Cursor | None = None) -> Iterator[tuple[_Span, Cursor]]:
        """The spans from ``start`` on, up to ``rows`` rows or to ``end``, each with the cursor behind it."""
        epoch, shard, row = start["epoch"], start["shard"], start["row"]
        while epoch < self.epochs and self.shards and (rows is None or rows > 0):
            if end is not None and (epoch, shard, row) >= (end["epoch"], end["shard"], end["row"]):
                return
            order = self.order(epoch)
            size = order[shard]["rows"]
            stop = size if rows is None else min(size, row + rows)
            if end is not None and (epoch, shard) == (end["epoch"], end["shard"]):
                stop = min(stop, end["row"])
            span = _Span(epoch, order[shard], sum(e["rows"] for e in order[:shard]), row, stop)
            rows = None if rows is None else rows - (stop - row)
            epoch, shard, row = (epoch, shard, stop) if stop < size else (epoch, shard + 1, 0) if shard + 1 < len(order) else (epoch + 1, 0, 0)
            yield span, {"epoch": epoch, "shard": shard, "row": row}

    def latestOffset(self) -> Cursor:
        self.at = self.at or self.initialOffset()
        end = self.at
        for _, end in self.spans(self.at, self.rows):
            pass
        return end

    def partitions(self, start: Cursor, end: Cursor) -> list[_Span]:
        self.at = end  # a query that goes on plans its last batch first: so the cursor is known again
        return [span for span, _ in self.spans(start, end=end)]

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        entry = partition.entry
        name = f"shard {entry['shard']} of {self.path}"
        with pa.memory_map(f"{local(self.path)}/shards/{entry['file']}") as held:
            file = pa.ipc.open_file(held)
            batches = list(check_batches(name, entry, (file.get_batch(i) for i in range(file.num_record_batches)), file.schema.names))
        table = pa.Table.from_batches(batches, file.schema)
        keys = table[self.key].to_pylist()
        places = sorted(range(len(keys)), key=lambda i: (_order(self.seed, partition.epoch, keys[i]), i))[partition.first : partition.stop]
        if len(places) != partition.stop - partition.first:
            raise SealError(f"{name}: the cursor lies behind its rows")
        taken = table.take(pa.array(places, pa.int64())).append_column("epoch", pa.array([partition.epoch] * len(places), pa.int64()))
        first = partition.base + partition.first
        yield from taken.append_column("position", pa.array(range(first, first + len(places)), pa.int64())).combine_chunks().to_batches()

    def commit(self, end: Cursor) -> None:
        pass


class EpochSource(DataSource):
    """``spark.readStream.format("sealed_epochs")``; options path, seed, epochs, rows (a trigger) and digest."""

    @classmethod
    def name(cls) -> str:
        return "sealed_epochs"

    def schema(self) -> StructType:
        return StructType.fromJson(manifest(self.options["path"])["schema"]).add("epoch", LongType()).add("position", LongType())

    def streamReader(self, schema: StructType) -> EpochReader:
        return EpochReader(dict(self.options))


def epoch_stream(spark: SparkSession, path: str, seed: str, epochs: int, rows: int, expected: str | None = None) -> DataFrame:
    """The rows of a sealed table ``epochs`` times over, with ``epoch`` and ``position`` in it, ``rows`` a trigger; an empty table gives none."""
    spark.dataSource.register(EpochSource)
    options = {"path": path, "seed": seed, "epochs": str(epochs), "rows": str(rows)} | ({"digest": expected} if expected else {})
    return spark.readStream.format("sealed_epochs").options(**options).load()


def cursor(checkpoint: str) -> Cursor | None:
    """Where the next trigger of a query begins, by its checkpoint in a mounted folder; None before the first."""
    import os

    place = f"{local(checkpoint)}/offsets"
    logs = [int(x) for x in os.listdir(place) if x.isdigit()] if os.path.isdir(place) else []
    if not logs:
        return None
    with open(f"{place}/{max(logs)}") as f:
        return json.loads(f.read().splitlines()[-1])
