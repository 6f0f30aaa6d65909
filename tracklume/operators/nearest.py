"""Least distances of places to others by groups: pairs are made in blocks of arrays inside tasks, and none leaves them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task holds at most about so many others at once, for so many places; it has so many pairs in one block.
OTHERS, PLACES, PAIRS = 250_000, 25_000, 1 << 18
KEYS = ["hour", "part", "share"]
RESULT = "hour long, x double, y double, least array<struct<slot long, square double>>, near array<struct<square double, id long>>"
_LEAST = pa.struct([("slot", pa.int64()), ("square", pa.float64())])
_NEAR = pa.struct([("square", pa.float64()), ("id", pa.int64())])


def nearest(places: DataFrame, others: DataFrame) -> DataFrame:
    """Of each place (hour, x, y) the others (hour, x, y, slot, id) of its hour that can tell, by squared distance.

    ``least`` has each slot's least square and ``near`` the others that are
    nearest but for 1e-9 of distance, of equally distant ones the least id; a
    square is null where either has no place.  An hour of many others has
    several rows of a place, each for a share of them.
    """
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda rows, size, name: rows.groupBy("hour").agg(F.ceil(F.count("*") / size).alias(name))
    cut = blocks(places, PLACES, "parts").join(blocks(others, OTHERS, "shares"), "hour")
    dealt = lambda of, names: F.pmod(F.xxhash64(*names), F.col(of)).alias(of[:-1])
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1)).alias(of[:-1])
    none = F.lit(None).cast("long")
    left = places.join(cut, "hour").select("hour", dealt("parts", ["x", "y"]), each("shares"), F.lit(1).alias("last"), "x", "y", none.alias("slot"), none.alias("id"))
    right = others.join(cut, "hour").select("hour", each("parts"), dealt("shares", ["x", "y", "slot"]), F.lit(0).alias("last"), "x", "y", "slot", "id")
    return right.unionByName(left).repartition(n, *KEYS).sortWithinPartitions(*KEYS, "last", "slot").mapInArrow(_told, RESULT)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Others come before the places of their part and share."""
    key, held, others = None, [], None
    for batch in batches:
        at = np.stack([batch[c].to_numpy() for c in (*KEYS, "last")], axis=1)
        for i, j in pairwise([0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(at)]):
            if i == j:
                continue
            *own, last = at[i].tolist()
            if own != key:
                key, held, others = own, [], None
            if not last:
                held.append(batch.slice(i, j - i))
                continue
            if held:
                others, held = _Others(pa.Table.from_batches(held)), []
            if others:
                yield others.told(batch.slice(i, j - i))


def _numbers(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both coordinates, and whether a row has both."""
    table = rows if isinstance(rows, pa.Table) else pa.Table.from_batches([rows])
    x, y = (table[c].to_numpy() for c in "xy")
    return x, y, pc.and_(table["x"].is_valid(), table["y"].is_valid()).to_numpy()


class _Others:
    """A share of an hour's others, by slots."""

    def __init__(self, rows: pa.Table):
        x, y, there = _numbers(rows)
        self.first, self.none = pc.min(rows["id"]).as_py(), not there.any()
        self.x, self.y = x[there], y[there]
        self.id, slot = (rows.filter(pa.array(there))[c].to_numpy().astype(np.int64) for c in ("id", "slot"))
        self.starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]][: len(slot)])
        self.slots = slot[self.starts]

    def told(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        x, y, there = _numbers(rows)
        least, near, step = [], [], max(1, PAIRS // max(1, len(self.x)))
        # Rows of what is found: its place, then the values.
        for i in range(0, len(x), step) if not self.none else ():
            at = i + np.flatnonzero(there[i : i + step])
            if len(at):
                for into, (row, *values) in zip((least, near), self._block(x[at], y[at]), strict=True):
                    into.append((at[row], *values))
        without = np.arange(len(x)) if self.none else np.flatnonzero(~there)
        return pa.RecordBatch.from_arrays(
            [rows["hour"], rows["x"], rows["y"], _lists(len(x), least, _LEAST), _lists(len(x), near, _NEAR, without, self.first)], ["hour", "x", "y", "least", "near"]
        )

    def _block(self, x: np.ndarray, y: np.ndarray):
        """(row, slot, square) of the least squares by slots, (row, square, id) of the near ones."""
        with np.errstate(all="ignore"):
            square, dy = x[:, None] - self.x, y[:, None] - self.y
            square *= square
            dy *= dy
            square += dy
            odd = None if np.isfinite(square.sum()) else np.isnan(square)
            if odd is not None and odd.any():
                square[odd] = np.inf
            else:
                odd = None
            least = np.minimum.reduceat(square, self.starts, axis=1)
            low = least.min(axis=1)
            within = square <= ((np.sqrt(low) + 2e-9) ** 2 * (1 + 1e-14))[:, None]
        if odd is not None:
            within &= ~odd
        row, col = np.nonzero(within)
        found, ids = square[row, col], self.id[col]
        order = np.lexsort((ids, found, row))
        row, found, ids = row[order], found[order], ids[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (found[1:] != found[:-1])][: len(row)]
        near = row[new], found[new], ids[new]
        told = np.repeat(np.arange(len(x)), len(self.slots)), np.tile(self.slots, len(x)), least.ravel()
        if odd is not None:
            # Distances that are no numbers: one beside the slots of its place, and the least id of them.
            none = np.flatnonzero(odd.any(axis=1))
            nan, first = np.full(len(none), np.nan), np.array([self.id[o].min() for o in odd[none]])
            told = tuple(np.concatenate(c) for c in zip(told, (none, np.zeros(len(none), np.int64), nan), strict=True))
            near = tuple(np.concatenate(c) for c in zip(near, (none, nan, first), strict=True))
        return told, near


def _lists(n: int, blocks: list[tuple], kind: pa.StructType, without: np.ndarray | None = None, least: int | None = None) -> pa.ListArray:
    """A list for each of ``n`` rows, of the structs that name it; rows ``without`` a distance have one of no square and the ``least`` id."""
    columns = [np.concatenate(c) for c in zip(*blocks, strict=True)] if blocks else [np.array([], int) for _ in range(1 + len(kind))]
    values = [pa.array(c).cast(f.type) for c, f in zip(columns[1:], kind, strict=True)]
    row = columns[0]
    if without is not None and len(without):
        row = np.concatenate([row, without])
        values = [pa.concat_arrays([v, pa.array([x] * len(without), v.type)]) for v, x in zip(values, (None, least), strict=True)]
    order = np.argsort(row, kind="stable")
    offsets = np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([v.take(pa.array(order)) for v in values], fields=list(kind)))
