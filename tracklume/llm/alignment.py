"""Alignment of two tokenizers' tokens of the same texts.

Both sides' tokens of many texts stand as arrays in the order of their bytes,
so a token's range is a running sum of lengths.  Where a token of either side
begins at a place, there begins a group: the equi-join on (text, end) is a
merge of two sorted arrays.  A link is a pair of tokens whose byte ranges
overlap.  It begins where the later of the two begins, and there it is the last
token of either side that has begun: so the range join makes a row a link, at
each distinct begin, where a join of a group's tokens would make all their pairs.

Texts are tokenized and aligned a block at a time, and a block's documents are
written with the id pairs that each of them holds.  How many documents of the
corpus hold a pair is counted by Spark: pairs are grouped by block, summed up,
joined with the blocks that hold them, and meet their documents again by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklume.llm import text as T
from tracklume.llm.scratch import Scratch, small_batches

#: Bytes of text that are aligned at a time; the documents of a block meet the counts of its pairs in one group.
BLOCK_BYTES = 2 << 20
_DOCUMENTS = "block long, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
_LINKS = "row long, begin long, a_id int, b_id int, a_at int, b_at int, group int, cut boolean"

#: The ids of a text, and the bytes of each id.
Encoder = tuple[Callable[[str], list[int]], list[bytes]]
#: Both sides' ids of texts, and how many each text has: ids, counts, ids, counts.
Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def whole_texts(encoders: tuple[Encoder, Encoder]) -> Callable[[list[str | None]], Tokens]:
    """Both sides' tokens of texts, none where a side's bytes aren't a space and the text."""

    def run(texts: list[str | None]) -> Tokens:
        columns: list[list[list[int]]] = [[], []]
        for text in texts:
            found = [encode(text) if text else [] for encode, _ in encoders]
            whole = f" {text or ''}".encode()
            if not all(b"".join(map(table.__getitem__, ids)) == whole for ids, (_, table) in zip(found, encoders, strict=True)):
                found = [[], []]
            for column, ids in zip(columns, found, strict=True):
                column.append(ids)
        return tuple(x for c in columns for x in (np.array([i for ids in c for i in ids], np.int64), np.array(list(map(len, c)), np.int64)))

    return run


class Aligned(NamedTuple):
    """Links in order: doc, begin (in all texts' bytes), a and b (places of tokens), group, and cut; first_a, first_b, start: of each text its first tokens and byte, then the ends; ids of both sides."""

    doc: np.ndarray
    begin: np.ndarray
    a: np.ndarray
    b: np.ndarray
    group: np.ndarray
    cut: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    start: np.ndarray
    a_ids: np.ndarray
    b_ids: np.ndarray


def _marks(places: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[places] = True
    return out


def aligned(tokens: Tokens, sizes: tuple[np.ndarray, np.ndarray]) -> Aligned:
    a_ids, n_a, b_ids, n_b = tokens
    first_a, first_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
    ends_a = np.cumsum(sizes[0][a_ids])
    start = np.r_[0, ends_a][first_a]
    begins_a, begins_b = ends_a - sizes[0][a_ids], np.cumsum(sizes[1][b_ids]) - sizes[1][b_ids]
    # Tokens without bytes overlap with nothing, and begin no group.
    some_a, some_b = np.flatnonzero(sizes[0][a_ids]), np.flatnonzero(sizes[1][b_ids])
    marks_a, marks_b = _marks(begins_a[some_a], start[-1]), _marks(begins_b[some_b], start[-1])
    begin = np.flatnonzero(marks_a | marks_b)
    a, b = some_a[np.cumsum(marks_a)[begin] - 1], some_b[np.cumsum(marks_b)[begin] - 1]
    cut = marks_a[begin] & marks_b[begin]
    return Aligned(np.repeat(np.arange(len(n_a)), n_a)[a], begin, a, b, np.cumsum(cut) - 1, cut, first_a, first_b, start, a_ids, b_ids)


def written_groups(x: Aligned) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    # A group goes from its first tokens to the next group's.
    cut_a, cut_b = x.a[x.cut], x.b[x.cut]
    group_a, group_b = np.cumsum(_marks(cut_a, len(x.a_ids))) - 1, np.cumsum(_marks(cut_b, len(x.b_ids))) - 1
    place_a, place_b = np.arange(len(x.a_ids)) + cut_b[group_a], np.arange(len(x.b_ids)) + np.r_[cut_a, len(x.a_ids)][group_b + 1]
    n = int(max(x.a_ids.max(initial=0), x.b_ids.max(initial=0))) + 1
    after = np.zeros(len(x.a_ids) + len(x.b_ids), np.int64)  # which mark follows: a comma, a bar, a semicolon or none
    ids = np.empty(len(after), np.int64)
    ids[place_a], ids[place_b] = x.a_ids, x.b_ids
    after[place_b[cut_b] - 1] = 1
    after[place_a[cut_a[cut_a > 0]] - 1] = 2
    first = x.first_a + x.first_b
    after[first[1:][np.diff(first) > 0] - 1] = 3
    used, code = np.unique(after * n + ids, return_inverse=True)
    names = pa.array([f"{k % n}{',|;'[k // n : k // n + 1]}" for k in used.tolist()], pa.large_string())
    data, offsets = T.buffers(names.take(pa.array(code)))
    return [str(data[lo:hi], "ascii") for lo, hi in pairwise(offsets[first].tolist())]


def _held(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct id pairs of each text (text, pair, how many links), sorted, and where each text's begin."""
    used, code = np.unique(x.a_ids[x.a] << 32 | x.b_ids[x.b], return_inverse=True)
    keys, times = np.unique(x.doc * max(1, len(used)) + code, return_counts=True)
    doc, code = np.divmod(keys, max(1, len(used)))
    return doc, used[code], times, np.searchsorted(doc, np.arange(len(x.first_a)))


def _batch(columns: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x for _, x in columns], names=[k for k, _ in columns])


class Alignment:
    """``docs`` (doc_id, text), tokenized by both ``encoders`` of a worker; ``cut`` makes of them what gives the tokens of many texts (see ``whole_texts``).

    Null and empty texts, and those that a tokenizer doesn't give back, have no
    tokens, links or groups.  Repeated rows are documents of their own, a null
    doc_id stays null, an empty table gives none; other columns are not read.
    """

    def __init__(self, docs: DataFrame, encoders: Callable[[], tuple[Encoder, Encoder]], cut: Callable[[tuple[Encoder, Encoder]], Callable[[list[str | None]], Tokens]] = whole_texts):
        self.spark = docs.sparkSession
        self.scratch, self.encoders, self.cut = Scratch(self.spark, "alignment"), encoders, cut
        self.docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def _blocks(self, schema: str, made: Callable[[pa.RecordBatch, Aligned, int], pa.RecordBatch]) -> DataFrame:
        encoders, cut = self.encoders, self.cut

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sides = encoders()
            tokens, sizes = cut(sides), tuple(np.fromiter(map(len, table), np.int64, len(table)) for _, table in sides)
            block = TaskContext.get().partitionId() << 32
            for batch in T.chunks(batches, size=BLOCK_BYTES):
                yield made(batch, aligned(tokens(batch.column(2).to_pylist()), sizes), block)
                block += 1

        return self.docs.mapInArrow(run, schema)

    def links(self) -> DataFrame:
        """A row for each pair of tokens with overlapping bytes: row, begin, a_id, b_id, a_at, b_at, group (from 1), and cut: whether a group begins with it."""

        def made(batch: pa.RecordBatch, x: Aligned, _: int) -> pa.RecordBatch:
            before = np.searchsorted(x.doc[x.cut], np.arange(len(x.first_a)))
            columns = x.a_ids[x.a], x.b_ids[x.b], x.a - x.first_a[x.doc], x.b - x.first_b[x.doc], x.group + 1 - before[x.doc]
            numbers = [("row", batch.column(0).take(pa.array(x.doc))), ("begin", pa.array(x.begin - x.start[x.doc]))]
            return _batch([*numbers, *((k, pa.array(c.astype(np.int32))) for k, c in zip(("a_id", "b_id", "a_at", "b_at", "group"), columns, strict=True)), ("cut", pa.array(x.cut))])

        return self._blocks(_LINKS, made)

    def groups(self) -> DataFrame:
        """row, n_groups and ``groups``, the text of its groups; texts without tokens are not there."""

        def made(batch: pa.RecordBatch, x: Aligned, _: int) -> pa.RecordBatch:
            n = np.bincount(x.doc[x.cut], minlength=batch.num_rows)
            return _batch([("row", batch.column(0)), ("n_groups", pa.array(n)), ("groups", pa.array(written_groups(x), pa.string()))]).filter(pa.array(n > 0))

        return self._blocks("row long, n_groups long, groups string", made)

    def documents(self) -> DataFrame:
        """A row a document: its block, row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct id pairs of its links (a's in the upper 32 bits) with how many links have each."""

        def made(batch: pa.RecordBatch, x: Aligned, block: int) -> pa.RecordBatch:
            _, pairs, times, first = _held(x)
            first = pa.array(first.astype(np.int32))
            numbers = np.diff(x.first_a), np.diff(x.first_b), np.bincount(x.doc[x.cut], minlength=batch.num_rows), np.bincount(x.doc, minlength=batch.num_rows)
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in written_groups(x)]
            columns = [("block", pa.array(np.full(batch.num_rows, block))), ("row", batch.column(0)), ("doc_id", batch.column(1))]
            columns += [(k, pa.array(n)) for k, n in zip(("n_a", "n_b", "n_groups", "n_links"), numbers, strict=True)]
            lists = pa.ListArray.from_arrays(first, pa.array(pairs)), pa.ListArray.from_arrays(first, pa.array(times.astype(np.int32)))
            return _batch([*columns, ("groups_sha256", pa.array(digests, pa.string())), ("pairs", lists[0]), ("times", lists[1])])

        return self._blocks(_DOCUMENTS, made)

    def summary(self) -> DataFrame:
        """A row a document: doc_id, n_a, n_b, n_groups, n_links, n_best (links of the most held pair of their a_id), count_sum (over links, how many rows hold their pair), groups_sha256 (empty without tokens), written."""
        numbers = ["n_a", "n_b", "n_groups", "n_links"]
        with small_batches(self.spark):
            documents = self.scratch.write(self.documents(), "documents")
            held = documents.select("block", F.explode("pairs").alias("pair")).groupBy("block", "pair").agg(F.count("*").alias("n"))
            held = self.scratch.write(held, "held")
            counts = held.groupBy("pair").agg(F.sum("n").alias("holders"))
            most = F.max("holders").over(Window.partitionBy(F.shiftright("pair", 32)))
            told = held.select("block", "pair").join(counts.withColumn("best", F.col("holders") == most), "pair")
            schema = f"doc_id long, {', '.join(f'{x} long' for x in numbers)}, n_best long, count_sum long, groups_sha256 string"

            def met(docs: pa.Table, told: pa.Table) -> pa.Table:
                docs, pair = docs.combine_chunks(), told["pair"].to_numpy()
                order, lists = np.argsort(pair), docs["pairs"].combine_chunks()
                size = lists.value_lengths().to_numpy(False)
                at = order[np.searchsorted(pair, lists.flatten().to_numpy(False), sorter=order)] if len(pair) else np.zeros(0, np.int64)
                times, doc = docs["times"].combine_chunks().flatten().to_numpy(False).astype(np.int64), np.repeat(np.arange(len(size)), size)
                total = lambda x: pa.array(np.diff(np.r_[0, np.cumsum(x)][np.r_[0, np.cumsum(size)]]))
                assert len(doc) == len(times)
                n_best, count_sum = total(times * told["best"].to_numpy().astype(np.int64)[at]), total(times * told["holders"].to_numpy()[at])
                return pa.table([docs["doc_id"], *(docs[x] for x in numbers), n_best, count_sum, docs["groups_sha256"]], names=["doc_id", *numbers, "n_best", "count_sum", "groups_sha256"])

            rows = documents.select("block", "doc_id", *numbers, "groups_sha256", "pairs", "times")
            return self.scratch.keep(rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(met, schema), "summary")
