"""Benchmark decontamination by latent semantic retrieval.

1. *TF-IDF.*  Document frequencies of hashed terms are counted over all texts.
2. *Latent space.*  A randomised SVD of the TF-IDF matrix of passages: every
   passage of the benchmark, weighted, and every passage of the corpus.  Tasks
   add up the products of terms of a passage, and slices of the sums stay in
   the cluster, where they are multiplied; where the benchmark has too many
   terms for that, tasks multiply their rows with a random matrix and back, and
   matrices of (terms x dimensions) are added up.
3. *Candidates.*  An inverted index of every item's rarest words tells which
   texts may pass the checks; it misses none.  Of these, every passage of those
   that hold enough of an item in order is projected and compared with every
   benchmark passage by cosine.  A passage
   whose weight outside the benchmark's terms alone keeps it under the threshold
   isn't projected: the space is orthonormal, so that bound is exact.  The
   cosine ranks what is found, but decides nothing alone: what a space of any
   dimensions leaves out is found by the index.
4. *Checks.*  The longest common subsequence of a benchmark item and the text
   around a candidate, and how much of the item's answer (its last sentence)
   stands there in order.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.llm import text as T
from tracklume.llm.scratch import Scratch, small_batches

#: Hashed terms, words of a block, blocks of a passage (which starts at every block).
TERMS, BLOCK, BLOCKS = 1 << 18, 16, 2
#: Terms in more than this share of documents weigh nothing, but for those of benchmark passages that would keep fewer than LEAST_TERMS.
STOP_SHARE, LEAST_TERMS = 0.1, 4
#: Least weight of a term that isn't left out: in a table of few documents a term can be in all of them.
LEAST_IDF = 0.1
#: Benchmark terms that the latent space is built on, at most (the rarest stay), and its dimensions.
MAX_VOCABULARY, DIMENSIONS = 20_000, 256
#: Benchmark terms up to which their products are held, a square matrix a task.
GRAM_TERMS = 4_096
#: Weight of benchmark passages beside corpus passages in the SVD.
BENCHMARK_WEIGHT = 16.0
#: Benchmark items in one search, about, and bytes of their texts: every task holds them.  A larger benchmark is searched in parts.
PART_ITEMS, PART_BYTES = 25_000, 16 << 20
#: Least cosine of a candidate, and the shares of the common subsequence and of the answer from which on a text is contaminated.
COSINE, VERBATIM, PARAPHRASE, ANSWER = 0.25, 0.8, 0.6, 0.8
#: Bytes of text that are worked on at a time: what is held of them are arrays of some times their size.
CHUNK_BYTES = 1 << 20
_PROJECT_ROWS, _FEW, _ENTRIES, _PAIR_ROWS = 1 << 12, 64, 1 << 20, 1 << 13
_SENTENCE = re.compile(r"[.!?]+\s+")


class Space(NamedTuple):
    """idf: weight of each hashed term; place: its row in ``basis``, or -1; items: unit vectors of benchmark passages and the item of each; counts: documents of each term."""

    idf: np.ndarray
    place: np.ndarray
    basis: np.ndarray
    items: np.ndarray
    owner: np.ndarray
    counts: np.ndarray


def _terms(texts: pa.Array) -> tuple[T.Words, np.ndarray]:
    w = T.words(texts, lower=True, breaks=T.PUNCTUATION)
    return w, (w.hashes % np.uint64(TERMS)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed term stands, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(TERMS, np.int64), 0
        for chunk in T.chunks(batches, size=CHUNK_BYTES):
            w, terms = _terms(chunk.column(0))
            counts += np.bincount(np.unique(w.doc * TERMS + terms) % TERMS, minlength=TERMS)
            rows += chunk.num_rows
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[counts[some], rows])], names=["term", "n"])

    found = texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    with small_batches(texts.sparkSession):
        found = found.toPandas()
    counts = np.zeros(TERMS, np.int64)
    terms, n = found["term"].to_numpy(int), found["n"].to_numpy(int)
    counts[terms[terms >= 0]] = n[terms >= 0]
    return counts, int(n[terms < 0].sum())


def _blocks(w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block of each word, the text of each block, and whether the next block is of the same text."""
    within = np.arange(len(w.hashes)) - w.first[w.doc]
    per_text = -(-np.diff(w.first) // BLOCK)
    first = np.r_[0, np.cumsum(per_text)]
    doc = np.repeat(np.arange(len(per_text)), per_text)
    return first[w.doc] + within // BLOCK, doc, np.r_[doc[1:] == doc[:-1], np.zeros(min(1, len(doc)), bool)]


def _pairs(values: np.ndarray, paired: np.ndarray) -> np.ndarray:
    """Sums over each block and the next one of its text: BLOCKS is two."""
    out = values.copy()
    out[:-1][paired[:-1]] += values[1:][paired[:-1]]
    return out


def _rows(texts: pa.Array, idf: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The TF-IDF matrix of the passages of texts: (passage, term place, weight) entries, and the norm and text of each passage."""
    w, terms = _terms(texts)
    block, doc, paired = _blocks(w)
    weight = idf[terms]
    norms = np.sqrt(_pairs(np.bincount(block, weight**2, len(paired)), paired))
    known = place[terms] >= 0
    at, column, value = block[known], place[terms[known]], weight[known]
    before = np.r_[np.zeros(min(1, len(paired)), bool), paired[:-1]]  # the word also is in the passage of the block before
    too = before[at]
    return np.r_[at, at[too] - 1], np.r_[column, column[too]], np.r_[value, value[too]], norms, doc


def _times(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int, matrix: np.ndarray) -> np.ndarray:
    """A sparse matrix of n rows times a dense one."""
    out = np.zeros((n, matrix.shape[1]), np.float32)
    order = np.argsort(rows, kind="stable")
    rows, columns, values = rows[order], columns[order], values[order].astype(np.float32)
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else rows
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    if len(rows) and rank.max() < _FEW:  # short rows: the first entries of all, then the second ones, ...
        by_rank = np.argsort(rank, kind="stable")
        for part in np.split(by_rank, np.cumsum(np.bincount(rank))[:-1]):
            for a in range(0, len(part), _PROJECT_ROWS):
                some = part[a : a + _PROJECT_ROWS]
                out[rows[some]] += matrix[columns[some]] * values[some, None]
        return out
    for a in range(0, len(rows), _PROJECT_ROWS):
        part = slice(a, a + _PROJECT_ROWS)
        starts = np.flatnonzero(np.r_[True, rows[part][1:] != rows[part][:-1]])
        out[rows[part][starts]] += np.add.reduceat(matrix[columns[part]] * values[part, None], starts, axis=0)
    return out


_SLICES = "a long, part binary"


def _step(width: int) -> int:
    """Rows of a slice of a matrix."""
    return max(1, (1 << 18) // width)


def _slice(a: int, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([rows.astype(np.float32).tobytes()], pa.binary())], names=["a", "part"])


def _gathered(slices: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, np.float32)
    with small_batches(slices.sparkSession):
        found = slices.collect()
    for r in found:
        rows = np.frombuffer(r["part"], np.float32).reshape(-1, shape[1])
        out[r["a"] : r["a"] + len(rows)] = rows
    return out


def _triangle(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The places of a symmetric matrix's entries in an array that holds each of them once."""
    high = np.maximum(i, j)
    return high * (high + 1) // 2 + np.minimum(i, j)


def _added(passages: DataFrame, held: Broadcast, shape: tuple[int, int], add: Callable[[np.ndarray, tuple, pa.Array, np.ndarray], None], symmetric: bool = False) -> DataFrame:
    """Slices of what ``add`` adds to a matrix of ``shape`` (a ``_triangle`` if ``symmetric``) for each chunk of (text, weight): each task adds up its own, slices of which are added over tasks."""
    step = _step(shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shape[0]
        total = np.zeros(n * (n + 1) // 2 if symmetric else shape)
        for chunk in T.chunks(batches, size=CHUNK_BYTES):
            add(total, held.value, chunk.column(0), chunk.column(1).to_numpy())
        for a in range(0, shape[0], step):
            yield _slice(a, total[_triangle(np.arange(a, min(a + step, n))[:, None], np.arange(n))] if symmetric else total[a : a + step])

    def merge(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_slice(table["a"][0].as_py(), sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table["part"]))])

    return passages.select("text", "weight").mapInArrow(run, _SLICES).groupBy("a").applyInArrow(merge, _SLICES)


def _weighted(texts: pa.Array, weights: np.ndarray, idf: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The entries of ``_rows``, of unit passages times their text's weight, and how many passages there are."""
    rows, columns, values, norms, doc = _rows(texts, idf, place)
    return rows, columns, values / np.maximum(norms, 1e-9)[rows] * weights[doc[rows]], len(norms)


def _summed(passages: DataFrame, idf: np.ndarray, place: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A^T (A matrix) over the weighted passages of (text, weight)."""

    def add(total: np.ndarray, held: tuple, texts: pa.Array, weights: np.ndarray) -> None:
        idf, place, matrix = held
        rows, columns, values, n = _weighted(texts, weights, idf, place)
        if len(rows):
            total += _times(columns, rows, values, len(matrix), _times(rows, columns, values, n, matrix))

    held = passages.sparkSession.sparkContext.broadcast((idf, place, matrix.astype(np.float32)))
    return _gathered(_added(passages, held, matrix.shape, add), matrix.shape)


class Products:
    """A square matrix whose slices are written and stay in the cluster; a product with a narrow matrix comes to the driver."""

    def __init__(self, slices: DataFrame, terms: int):
        self.scratch, self.terms = Scratch(slices.sparkSession, "products"), terms
        with small_batches(slices.sparkSession):
            self.slices = self.scratch.write(slices, "slices")

    def __matmul__(self, matrix: np.ndarray) -> np.ndarray:
        held, terms = self.slices.sparkSession.sparkContext.broadcast(matrix.astype(np.float32)), self.terms

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, part in zip(*batch.columns, strict=True):
                    yield _slice(a.as_py(), np.frombuffer(part.as_buffer(), np.float32).reshape(-1, terms) @ held.value)

        return _gathered(self.slices.mapInArrow(run, _SLICES), matrix.shape)

    def __array__(self, dtype: np.dtype | None = None, copy: bool | None = None) -> np.ndarray:
        return _gathered(self.slices, (self.terms, self.terms)).astype(dtype or np.float32)

    def drop(self) -> None:
        self.scratch.drop()


def _products(passages: DataFrame, idf: np.ndarray, place: np.ndarray, terms: int) -> Products:
    """A^T A over the weighted passages of (text, weight): for each two entries of a passage their product."""

    def add(total: np.ndarray, held: tuple, texts: pa.Array, weights: np.ndarray) -> None:
        idf, place = held
        w, numbers = _terms(texts)
        block, doc, paired = _blocks(w)
        squares = (weights[doc] / np.maximum(np.sqrt(_pairs(np.bincount(block, idf[numbers] ** 2, len(paired)), paired)), 1e-9)) ** 2
        both = np.where(paired, squares, 0)  # of the passage that also holds the next block
        alone = squares + np.r_[np.zeros(min(1, len(both))), both[:-1]]  # of the passages that hold a block
        known = place[numbers] >= 0
        block, column, value = block[known], place[numbers[known]].astype(np.int64), idf[numbers[known]].astype(np.float64)
        # An entry's products with itself and all after it in its block and the next one; those with the ones before are the same.
        size = np.searchsorted(block, block + paired[block], "right") - np.arange(len(block))
        for a in range(0, len(block), _PAIR_ROWS):
            part = slice(a, a + _PAIR_ROWS)
            one = np.repeat(np.arange(a, min(a + _PAIR_ROWS, len(block))), size[part])
            other = np.arange(len(one)) - np.repeat(np.cumsum(size[part]) - size[part] - np.arange(a, a + len(size[part])), size[part])
            product = value[one] * value[other] * np.where(block[one] == block[other], alone[block[one]], both[block[one]])
            product[(one != other) & (column[one] == column[other])] *= 2  # both orders are one place
            np.add.at(total, _triangle(column[one], column[other]), product)

    spark = passages.sparkSession
    # A task a core: each sends a whole matrix, however many rows it has read.
    return Products(_added(passages.coalesce(spark.sparkContext.defaultParallelism), spark.sparkContext.broadcast((idf, place)), (terms, terms), add, True), terms)


def _light_terms(w: T.Words, terms: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The terms of passages in which fewer than LEAST_TERMS words are uncommon."""
    block, _, paired = _blocks(w)
    light = _pairs(np.bincount(block, ~common[terms], len(paired)), paired) < LEAST_TERMS
    inside = light | np.r_[np.zeros(min(1, len(light)), bool), (light & paired)[:-1]]
    return np.unique(terms[inside[block]])


def latent_space(docs: DataFrame, items: list[str], seed: int = 7) -> Space:
    """The space of a benchmark's passages among those of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    counts, n = document_frequencies(docs)
    idf = np.maximum(np.log((n + 1) / (counts + 1)), LEAST_IDF).astype(np.float32)
    w, terms = _terms(pa.array(items, pa.string()))
    common = counts > max(STOP_SHARE * n, 1)
    common[_light_terms(w, terms, common)] = False
    idf[common] = 0
    vocabulary = np.unique(terms)
    vocabulary = vocabulary[idf[vocabulary] > 0]
    vocabulary = vocabulary[np.argsort(counts[vocabulary], kind="stable")][:MAX_VOCABULARY]
    place = np.full(TERMS, -1, np.int32)
    place[vocabulary] = np.arange(len(vocabulary))
    dims = min(DIMENSIONS, len(vocabulary))
    bench = spark.createDataFrame(pa.table({"text": pa.array(items, pa.string()), "weight": np.full(len(items), BENCHMARK_WEIGHT)}))
    passages = docs.where("text is not null").select("text", F.lit(1.0).alias("weight")).union(bench)
    # Range finder with one power step: the sums are A^T A times the last basis.
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(vocabulary), dims)))[0] if dims else np.zeros((0, 0))
    products = _products(passages, idf, place, len(vocabulary)) if 0 < len(vocabulary) <= GRAM_TERMS else None
    for _ in range(2 if dims else 0):
        found = _summed(passages, idf, place, basis) if products is None else products @ basis
        basis = np.linalg.qr(found.astype(np.float64))[0]
    if products is not None:
        products.drop()
    rows, columns, values, norms, _ = _rows(pa.array(items, pa.string()), idf, place)
    vectors = _times(rows, columns, values, len(norms), basis.astype(np.float32))
    length = np.linalg.norm(vectors, axis=1)
    _, owner, _ = _blocks(w)
    some = length > 0
    return Space(idf, place, basis.astype(np.float32), vectors[some] / length[some, None], owner[some], counts)


def candidates(texts: pa.Array, space: Space, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word of the passage in it, item, cosine) of all passages and items of a cosine of ``least``."""
    w, terms = _terms(texts)
    block, doc, paired = _blocks(w)
    known = space.place[terms] >= 0
    squares = space.idf[terms] ** 2
    norms = np.sqrt(_pairs(np.bincount(block, squares, len(paired)), paired))
    inside = np.sqrt(_pairs(np.bincount(block[known], squares[known], len(paired)), paired))
    open_ = (norms > 0) & (inside >= least * norms)
    out: list[list[np.ndarray]] = [[], [], [], []]
    if not open_.any() or not len(space.items):
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.float32))
    needed = open_ | np.r_[False, (open_ & paired)[:-1]]
    words = np.flatnonzero(known & needed[block])
    numbers = np.cumsum(needed) - 1
    halves = _times(numbers[block[words]], space.place[terms[words]], space.idf[terms[words]], int(needed.sum()), space.basis)
    chosen = np.flatnonzero(open_)
    first_block = np.searchsorted(doc, doc[chosen])
    for a in range(0, len(chosen), 4096):
        part = chosen[a : a + 4096]
        vectors = halves[numbers[part]].copy()
        both = paired[part]
        vectors[both] += halves[numbers[part[both] + 1]]
        for b in range(0, len(space.items), 4096):
            cosines = vectors @ space.items[b : b + 4096].T / norms[part, None]
            some = np.flatnonzero(cosines.max(1) >= least)
            i, j = np.nonzero(cosines[some] >= least)
            i = some[i]
            for column, x in zip(out, (doc[part[i]], (part[i] - first_block[a : a + 4096][i]) * BLOCK, space.owner[b + j], cosines[i, j]), strict=True):
                column.append(x)
    return tuple(map(np.concatenate, out))


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by one bit an element of ``a``."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    all_ = (1 << len(a)) - 1
    v = all_
    for mask in map(where.get, b):
        if mask:  # others change nothing
            u = v & mask
            v = (v + u | v - u) & all_
    return len(a) - v.bit_count()


def answer_of(item: str) -> str:
    """The last sentence of an item; the last quarter of its words where there is one sentence only."""
    sentences = [x for x in _SENTENCE.split(item.strip()) if x.strip()]
    if len(sentences) > 1:
        return sentences[-1]
    words = item.split()
    return " ".join(words[-max(1, len(words) // 4) :])


class WordIndex:
    """Items of at most ``size`` words by their rarest words.

    Of an item's n words, n - need at most are missing from a text that holds
    ``need`` of them.  So of its n - need + m rarest words the text has m.
    Texts are looked at in spans that overlap by half: a text around a passage
    lies in the span in whose first half it starts.
    """

    def __init__(self, size: int, items: dict[int, list[int]], counts: np.ndarray):
        self.half, self.numbers = 2 * size + BLOCK * BLOCKS, np.array(list(items))
        self.least = np.zeros(len(items), np.int64)
        rows = []
        for slot, words in enumerate(items.values()):
            n = len(words)
            need = next(x for x in range(n + 1) if x / n >= PARAPHRASE)
            self.least[slot] = max(1, need // 3)
            rare = sorted(words, key=lambda x: (counts[x % TERMS], x))[: n - need + int(self.least[slot])]
            rows += [(word, slot, times) for word, times in Counter(rare).items()]
        rows.sort()
        self.words, starts = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
        self.starts = np.r_[starts, len(rows)]
        self.slots, self.times = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        self.some = np.zeros(TERMS, bool)
        self.some[(self.words % np.uint64(TERMS)).astype(np.int64)] = True

    def spans(self, w: T.Words, terms: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, number of the span in it, item) of all that have enough of an item's rarest words."""
        at = np.flatnonzero(self.some[terms])
        word = np.minimum(np.searchsorted(self.words, w.hashes[at]), len(self.words) - 1)
        same = self.words[word] == w.hashes[at]
        at, word = at[same], word[same]
        if not len(at):
            return
        first = np.r_[0, np.cumsum(-(-np.diff(w.first) // self.half))]
        number = (at - w.first[w.doc[at]]) // self.half
        span, too = first[w.doc[at]] + number, number > 0
        keys, n = np.unique(np.r_[span, span[too] - 1] * len(self.words) + np.r_[word, word[too]], return_counts=True)
        span, word = np.divmod(keys, len(self.words))
        lengths = self.starts[word + 1] - self.starts[word]
        ends = np.cumsum(lengths)
        borders = np.r_[np.flatnonzero(np.r_[True, span[1:] != span[:-1]]), len(span)]
        a, b = 0, 0
        while b < len(borders) - 1:  # whole spans, together of about _ENTRIES entries
            a = b
            done = ends[borders[a] - 1] if borders[a] else 0
            b = max(a + 1, int(np.searchsorted(ends[borders[1:] - 1], done + _ENTRIES, "right")))
            part = slice(borders[a], borders[b])
            local = np.repeat(np.cumsum(np.r_[False, span[part][1:] != span[part][:-1]]), lengths[part])
            entry = np.arange(len(local)) - np.repeat(np.cumsum(lengths[part]) - lengths[part], lengths[part]) + np.repeat(self.starts[word[part]], lengths[part])
            keys, inverse = np.unique(local * len(self.numbers) + self.slots[entry], return_inverse=True)
            found = np.bincount(inverse, np.minimum(self.times[entry], np.repeat(n[part], lengths[part])), len(keys))
            some = keys[found >= self.least[keys % len(self.numbers)]]
            spans = span[borders[a + some // len(self.numbers)]]
            doc = np.searchsorted(first, spans, "right") - 1
            yield from zip(doc.tolist(), (spans - first[doc]).tolist(), self.numbers[some % len(self.numbers)].tolist(), strict=True)


class Search:
    """A benchmark and its latent space; ``find`` gives the contaminated texts of a chunk."""

    def __init__(self, ids: list[int], items: list[str], space: Space):
        self.ids, self.items, self.space = ids, items, space
        self._wanted: list[list[int]] | None = None
        self._answers: list[list[int]] = []
        self._counts: list[Counter[int]] = []
        self._indexes: list[WordIndex] = []

    @staticmethod
    def _lists(texts: list[str]) -> list[list[int]]:
        w = T.words(pa.array(texts, pa.string()), lower=True, breaks=T.PUNCTUATION)
        return [w.hashes[w.first[i] : w.first[i + 1]].tolist() for i in range(len(texts))]

    def _prepare(self) -> None:
        self._wanted, self._answers = self._lists(self.items), self._lists(list(map(answer_of, self.items)))
        self._counts = [Counter(x) for x in self._wanted]
        sizes: dict[int, dict[int, list[int]]] = defaultdict(dict)
        for i, words in enumerate(self._wanted):
            if words:
                sizes[max(64, 1 << (len(words) - 1).bit_length())][i] = words
        self._indexes = [WordIndex(size, items, self.space.counts) for size, items in sizes.items()]

    def _present(self, i: int, words: set[int]) -> int:
        """How many words of an item are among these: no more can be common."""
        counts = self._counts[i]
        return sum(map(counts.__getitem__, counts.keys() & words))

    def _common(self, i: int, around: list[int], words: set[int] | None = None) -> float:
        """The share of an item that stands in order in a text of these ``words``; 0 where it is under PARAPHRASE."""
        size = len(self._wanted[i])
        if self._present(i, set(around) if words is None else words) < PARAPHRASE * size:
            return 0.0
        common = common_subsequence(self._wanted[i], around) / max(1, size)
        return common if common >= PARAPHRASE else 0.0

    def _passes(self, i: int, around: list[int]) -> tuple[float, float] | None:
        """The shares of the item and of its answer, if they make the text contaminated."""
        if not (common := self._common(i, around)):
            return None
        answer = common_subsequence(self._answers[i], around) / max(1, len(self._answers[i]))
        return (common, answer) if common >= VERBATIM or answer >= ANSWER else None

    def _hopeful(self, index: WordIndex, w: T.Words, terms: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The spans of an index (text, number, item) that hold enough of the item in order: what passes the checks lies in one of them."""
        last, held, words = None, [], set()
        for d, number, i in index.spans(w, terms):
            if last != (last := (d, number)):
                low = number * index.half
                held = w.hashes[w.first[d] + low : min(w.first[d + 1], w.first[d] + low + 2 * index.half)].tolist()
                words = set(held)
            if self._common(i, held, words):
                yield d, number, i

    def _cosine(self, i: int, passage: list[int]) -> float:
        """The largest cosine of a passage and those of an item, over all terms."""
        weights = lambda words: {t: n * float(self.space.idf[t]) for t, n in Counter(x % TERMS for x in words).items()}
        norm = lambda x: sum(v * v for v in x.values()) ** 0.5
        ours, best = weights(passage), 0.0
        for a in range(0, len(self._wanted[i]), BLOCK):
            theirs = weights(self._wanted[i][a : a + BLOCK * BLOCKS])
            both = norm(ours) * norm(theirs)
            best = max(best, sum(v * theirs.get(t, 0.0) for t, v in ours.items()) / both if both else 0.0)
        return best

    def find(self, texts: pa.Array) -> dict[tuple[int, int], list[float]]:
        """(text, item) and the largest cosine, share of the common subsequence and share of the answer."""
        if self._wanted is None:
            self._prepare()
        w, terms = _terms(texts)
        # Only texts that hold enough of an item in order can pass the checks: the others aren't projected.
        near = [(index, d, number, i) for index in self._indexes for d, number, i in self._hopeful(index, w, terms)]
        some, pairs = np.unique(np.array([x[1] for x in near], np.int64)), {(d, i) for _, d, _, i in near}
        if not near:
            return {}
        doc, start, item, cosine = candidates(texts.take(pa.array(some)), self.space, COSINE)
        doc = some[doc]
        best: dict[tuple[int, int], list[float]] = {}

        def keep(d: int, i: int, *measures: float) -> None:
            best[d, i] = [max(x) for x in zip(best.get((d, i), [0.0, 0.0, 0.0]), measures, strict=True)]

        def around(d: int, s: int, i: int) -> list[int]:
            size = len(self._wanted[i])
            return w.hashes[w.first[d] + max(0, s - size) : min(w.first[d + 1], w.first[d] + s + BLOCK * BLOCKS + size)].tolist()

        for d, s, i, c in zip(doc.tolist(), start.tolist(), item.tolist(), cosine.tolist(), strict=True):
            if (d, i) in pairs and (shares := self._passes(i, around(d, s, i))):
                keep(d, i, c, *shares)
        for index, d, number, i in near:
            low, end, size = number * index.half, int(w.first[d + 1] - w.first[d]), len(self._wanted[i])
            for s in range(-(-(low + size) // BLOCK) * BLOCK if number else 0, min(end, low + index.half + size), BLOCK):
                if shares := self._passes(i, around(d, s, i)):
                    keep(d, i, self._cosine(i, w.hashes[w.first[d] + s : min(w.first[d + 1], w.first[d] + s + BLOCK * BLOCKS)].tolist()), *shares)
        return best


def searches(docs: DataFrame, benchmark: DataFrame, items: int = PART_ITEMS, size: int = PART_BYTES) -> Iterator[Search]:
    """The search for ``benchmark`` (item_id, text) in ``docs`` (doc_id, text), in as many parts as its size asks for; none if it has no texts."""
    rows = benchmark.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = max(-(-count // items), -(-total // size))
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        if part:
            texts = [r["text"] for r in part]
            yield Search([r["item_id"] for r in part], texts, latent_space(docs.select("doc_id", "text"), texts))


_SCHEMA = "doc_id long, item_id long, cosine double, common double, answer double"


def contaminated(docs: DataFrame, benchmark: DataFrame, *part: int) -> DataFrame:
    """doc_id, item_id, cosine, common, answer: documents that hold a benchmark item, with the best of each measure.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text.  Null and
    empty texts hold and are held by nothing.  Documents stay where they are
    read; items go to every task, those of a large benchmark part by part.
    Repeated rows have a result each; other columns are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def found_in(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in T.chunks(batches, size=CHUNK_BYTES):
                best = held.value.find(chunk.column(1))
                names = chunk.column(0).to_pylist()
                columns = [[names[d] for d, _ in best], [held.value.ids[i] for _, i in best], *([x[k] for x in best.values()] for k in range(3))]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "cosine", "common", "answer"])

        return docs.mapInArrow(run, _SCHEMA)

    frames = [found_in(spark.sparkContext.broadcast(x)) for x in searches(docs, benchmark, *part)]
    return reduce(DataFrame.union, frames) if frames else spark.createDataFrame([], _SCHEMA)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *part: int) -> DataFrame:
    """``docs`` without the rows that ``contaminated`` finds, filtered where they are read."""
    spark, all_ = docs.sparkSession, docs

    def without(left: DataFrame, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in T.chunks(batches, size=CHUNK_BYTES):
                clean = np.ones(chunk.num_rows, bool)
                clean[[d for d, _ in held.value.find(chunk.column(chunk.schema.get_field_index("text")))]] = False
                yield chunk.filter(pa.array(clean))

        return left.mapInArrow(run, left.schema)

    for found in searches(all_, benchmark, *part):
        docs = without(docs, spark.sparkContext.broadcast(found))
    return docs
