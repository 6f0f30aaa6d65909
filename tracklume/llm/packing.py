"""Packing of token sequences by the sum-of-squares rule or best fit, whichever takes fewer.

A document goes where the squared counts of open bins per residual gap become
smallest: with N(h) open bins of gap h, a piece of size s that is put into a
gap h takes one bin from N(h) and gives one to N(h - s), and a bin that it
fills leaves the sum.  A fresh bin is opened only where no open one fits.
Documents are dealt to shards of bounded size, each of
which is packed alone; only lengths, never tokens, are shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.llm import text as T
from tracklume.llm.scratch import Scratch

#: Pieces that one task packs: enough that the few bins it can't fill don't count, few enough for memory.
SHARD_PIECES = 50_000


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and its offset there.  Longer pieces go first; of equal choices the tightest gap is taken."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by gap
    count = np.zeros(capacity + 1, np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        # What the sum becomes less what it was, for each gap from s on; a filled bin adds nothing.
        change = 2 - 2 * count[s:capacity] + 2 * count[: capacity - s]
        if s < capacity:
            change[0] -= 1 + 2 * count[0]
        change[count[s:capacity] == 0] = 1 << 60
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] < 1 << 60:
            gap = s + best
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``sum_of_squares``, but every piece goes to the tightest gap."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by gap
    gaps, made = 0, 0  # one bit a gap that has open bins
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        if fits := gaps >> s:
            gap = s + (fits & -fits).bit_length() - 1
            b = open_bins[gap].pop()
            if not open_bins[gap]:
                gaps ^= 1 << gap
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            gaps |= 1 << (gap - s)
    return bins, offsets


def fewest(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The packing of fewer bins; the sum-of-squares one if there are as many, or if none could be fewer."""
    found = sum_of_squares(lengths, capacity)
    made = int(found[0].max(initial=-1)) + 1
    if made <= math.ceil(int(lengths.sum()) / capacity):
        return found
    other = best_fit(lengths, capacity)
    return other if int(other[0].max(initial=-1)) + 1 < made else found


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else a shorter first piece, if any, and full ones."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = [0] * (first > 0) + list(range(first, n, capacity))
    return [(s, (first if s == 0 and first else capacity)) for s in starts]


_SPECIAL = "<|endoftext|>"
#: Scripts beyond which the two libraries' tables of letters and digits might be of different Unicode versions.
_FAR = regex.compile("[^\u0000-ɏ -⁯]")


@cache
def _encoder(tokenizer: str, ranks: str | None):
    """Token ids of a text by the ``tokenizers`` file; with the same vocabulary as ``tiktoken`` ranks, by those where both must agree."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    slow = lambda x: whole.encode(x, add_special_tokens=False).ids
    if not ranks:
        return slow
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda x: slow(x) if _SPECIAL in x or _FAR.search(x) else fast.encode_ordinary(x)


def token_pieces(docs: DataFrame, tokenizer: str, ranks: str | None, capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids, ended by ``end_id`` and cut to ``capacity``.

    ``docs`` has doc_id and text; a null text is empty, and so one piece of the
    end id alone.  Repeated rows give repeated pieces, told apart by ``row``,
    and a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, ranks)
        for batch in T.chunks(batches):
            rows: list[list] = [[], [], [], [], [], []]
            for doc, row, value in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids = np.array([*encode(value.as_py() or ""), end_id], "<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    for column, x in zip(rows, (doc.as_py(), row.as_py(), k, start, n, zlib.crc32(ids[start : start + n].tobytes())), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return narrow.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, count: int) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``count`` is about how many rows there are, and fixes the shards.

    Rows go to ceil(count / SHARD_PIECES) shards by a hash of all that tells
    them apart, so that no key can make a shard large.
    """
    shards = max(1, math.ceil(count / SHARD_PIECES))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        bins, offsets = fewest(table["length"].to_numpy(), capacity)
        shard = table["shard"][0].as_py()
        table = table.drop_columns(["shard"])
        return table.append_column("sequence_id", pa.array(bins + (shard << 40))).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def packed_pieces(docs: DataFrame, tokenizer: str, ranks: str | None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of every document with the sequence that holds it; an empty table gives none.

    The pieces are written once, so that texts are tokenized once; what is
    written is a few numbers a piece.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(token_pieces(docs, tokenizer, ranks, capacity, end_id), "pieces")
    return pack(pieces, capacity, pieces.count()).drop("row")
