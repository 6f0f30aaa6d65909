"""Which keys of documents recur in other documents, and who is their first owner, as rows.

A task sends, for each of its keys, the first and the last owner it saw: two
rows, however many of its documents hold the key.  If it saw more owners than
those, it knows that the key recurs, and their rows aren't dealt by the key:
so a key that a third of all documents share doesn't gather in one partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklume.llm import text as T
from tracklume.llm.scratch import partitions

KEY_ROWS = "x long, y long"
KEY_VALUE_ROWS = "x long, y long, v long"
OWNER_ROWS = "k long, l long, a long, b long, v long, more array<long>"


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=[x.split()[0] for x in schema.split(", ")])


def key_rows(keys: np.ndarray, owners: np.ndarray, values: np.ndarray | None = None) -> pa.RecordBatch:
    """The rows of a chunk's (key, owner, value) entries; keys and owners are below 2^63, and of equal (key, owner) one stays.

    x is the key and y the owner; where the chunk itself knows that the key
    recurs, x is the owner's complement and y the key.
    """
    keys, owners = keys.astype(np.int64), owners.astype(np.int64)
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    once = np.r_[True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])] if len(keys) else np.zeros(0, bool)
    keys, owners = keys[once], owners[once]
    inner = np.zeros(len(keys), bool)
    inner[1:-1] = (keys[1:-1] == keys[:-2]) & (keys[1:-1] == keys[2:])
    back = np.argsort(order[once])  # in the order of documents, in which owners compress
    columns = [np.where(inner, ~owners, keys)[back], np.where(inner, keys, owners)[back]]
    return _batch(KEY_ROWS, *columns) if values is None else _batch(KEY_VALUE_ROWS, *columns, values[order][once][back])


def recurring(rows: DataFrame) -> DataFrame:
    """(key, owner) of all keys that two owners have, with v if there is one, from rows of ``key_rows``; a row can come more than once."""
    group, told = Window.partitionBy("x"), F.col("x") < 0
    dealt = rows.repartition(partitions(rows.sparkSession), "x")
    met = dealt.select("*", F.min("y").over(group).alias("low"), F.max("y").over(group).alias("high")).where("low <> high or x < 0")
    key, owner = F.when(told, F.col("y")).otherwise(F.col("x")), F.when(told, F.bitwise_not("x")).otherwise(F.col("y"))
    return met.select(key.alias("key"), owner.alias("owner"), *rows.columns[2:])


def owner_rows(keys: np.ndarray, a: np.ndarray, b: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """The rows of a chunk's entries: ``keys`` are two columns, ``a`` may own, ``b`` goes along, values are not negative.

    Of a key only the entries of the chunk's least ``a`` are dealt by it, one
    row for all that (a, b) has; the others know that they come later, and say
    so by the complement of their value.
    """
    order = np.lexsort((values, b, a, keys[:, 1], keys[:, 0]))
    keys, a, b, values = keys[order].astype(np.int64), a[order], b[order], values[order].astype(np.int64)
    new = np.r_[True, (keys[1:] != keys[:-1]).any(1)] if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    later = a > np.repeat(a[starts], np.diff(np.r_[starts, len(keys)]))
    again = ~(later | new | np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(keys) else new
    dealt = T.mix((a.astype(np.uint64) << np.uint64(32)) + values.astype(np.uint64)).astype(np.int64)
    columns = (np.where(later, dealt, keys[:, 0]), np.where(later, 0, keys[:, 1]), a, b, np.where(later, ~values, values))
    size = np.diff(np.r_[np.flatnonzero(~again), len(keys)]) - 1  # entries that a row stands for besides its own
    more = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values[again]), mask=pa.array(size == 0))
    back = pa.array(np.argsort(order[~again]))
    rows = [pa.array(x[~again].astype(np.int64)) for x in columns] + [more]
    return pa.RecordBatch.from_arrays([x.take(back) for x in rows], names=["k", "l", "a", "b", "v", "more"])


def owned(rows: DataFrame) -> DataFrame:
    """a, b, vs (an array of values) of the entries of ``owner_rows``, with ``later``: whether a smaller ``a`` has the key too."""
    told, none = F.col("v") < 0, F.array().cast("array<long>")
    dealt = rows.repartition(partitions(rows.sparkSession), "k", "l").select("*", F.min("a").over(Window.partitionBy("k", "l")).alias("owner"))
    own = F.when(told, F.bitwise_not("v")).otherwise(F.col("v"))
    return dealt.select("a", "b", F.concat(F.array(own), F.coalesce("more", none)).alias("vs"), (told | (F.col("a") > F.col("owner"))).alias("later"))
