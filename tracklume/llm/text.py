"""Words and word n-grams of whole columns of texts, in numpy over Arrow buffers.

A word is ``[^\\x20\\x09-\\x0D]+``.  Words are hashed by their bytes, eight at
a time, for all words of a buffer at once; ``exact_ids`` compares the bytes
themselves, for what is decided by words and not only found by them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that one task holds as arrays at a time; a longer text stands alone.
CHUNK_BYTES = 4 << 20
_INNER_BYTES = 1 << 20
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_KEY = np.uint64(0x2545F4914F6CDD1D)
#: Words of more bytes are hashed one at a time.
_LONG_WORD = 256
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and ASCII punctuation.
PUNCTUATION = SPACE | np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For bytes: A-Z as a-z.
LOWER = _LOWER.tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """At each byte, it and the seven that follow as one integer; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def _lane(eights: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each start on, of which ``left`` count."""
    return eights[starts] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    out = mix(size.astype(np.uint64) ^ _KEY)
    eights, some, at = _eights(data), np.flatnonzero(size <= _LONG_WORD), 0
    while len(some):
        out[some] = mix(out[some] * _INVERSE + _lane(eights, starts[some] + at, size[some] - at))
        at += 8
        some = some[size[some] > at]
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], seed=int(_KEY))
    return out


class Words(NamedTuple):
    """starts, ends: byte spans in ``data`` (lower-cased, where that was asked for); hashes: 64 bits a word; first: of each text its first word, then the end; doc: each word's text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    doc: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets (one more than texts); nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string()) if texts.null_count else texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)), offsets - offsets[0]


def give_back() -> None:
    """Memory that arrays have left free goes back to the system: a Python worker outlives its tasks, and would hold the most that any of them needed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts pass ``size`` bytes; memory is given back behind the last one."""
    for batch in batches:
        _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def words(texts: pa.Array, lower: bool = False, breaks: np.ndarray = SPACE) -> Words:
    """Every word of every text; ``lower`` hashes A-Z as a-z; ``breaks`` marks the bytes that end a word."""
    data, offsets = buffers(texts)
    data = _LOWER[data] if lower else data
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _INNER_BYTES, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[to])
        at, cuts = to, offsets[at:to] - lo
        if hi == lo:
            continue
        solid = ~breaks[data[lo:hi]]
        before, after = np.empty_like(solid), np.empty_like(solid)
        before[0], before[1:] = False, solid[:-1]
        after[-1], after[:-1] = False, solid[1:]
        cuts = cuts[cuts < hi - lo]
        before[cuts] = False
        after[cuts[cuts > 0] - 1] = False
        s, e = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        hashes.append(_hashes(data[lo:hi], s, e))
        starts.append(s + lo)
        ends.append(e + lo)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    starts, ends, hashes = join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64)
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, hashes, first, np.repeat(np.arange(len(offsets) - 1), np.diff(first)))


def exact_ids(w: Words) -> np.ndarray:
    """A number for each word: equal ones stand for equal bytes, whatever the hashes are."""
    order = np.argsort(w.hashes, kind="stable")
    fresh = np.r_[True, w.hashes[order][1:] != w.hashes[order][:-1]] if len(order) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    ids = np.empty(len(order), np.int64)
    ids[order] = group
    leader = np.empty(len(order), np.int64)
    leader[order] = order[np.flatnonzero(fresh)][group] if len(order) else order
    size = w.ends - w.starts
    other = size != size[leader]
    eights, some, at = _eights(w.data), np.flatnonzero(~other & (leader != np.arange(len(leader)))), 0
    while len(some):
        same = _lane(eights, w.starts[some] + at, size[some] - at) == _lane(eights, w.starts[leader[some]] + at, size[some] - at)
        other[some[~same]] = True
        at += 8
        some = some[same & (size[some] > at)]
    names: dict[bytes, int] = {}
    for i in np.flatnonzero(other).tolist():  # words of equal hash but other bytes
        ids[i] = names.setdefault(w.data[w.starts[i] : w.ends[i]].tobytes(), len(order) + len(names))
    return ids


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """64 bits for the n words from each word on; the last n - 1 hold nothing of use."""
    out = np.zeros(len(hashes), np.uint64)
    for i in range(min(n, len(hashes))):
        out[: len(hashes) - i] = out[: len(hashes) - i] * _INVERSE + mix(hashes[i:] + np.uint64(i + 1))
    return mix(out)


def whole(w: Words, n: int) -> np.ndarray:
    """True at the words from which on n words stand in the same text."""
    return np.arange(len(w.hashes)) + n <= np.repeat(w.first[1:], np.diff(w.first))
