"""Substring dedup by repeated-phrase automata.

1. *Candidates.*  Of the 5-word phrases in each 13-word window the one of least
   hash stands for the window; equal windows have equal phrases.  Texts that
   share a phrase's hash are found by exchanging the hashes (``shared_keys``);
   equal texts are one here, and only their smallest doc_id is looked at.
2. *Confirmation.*  The words of such phrases meet; those that two texts have
   are confirmed to recur.
3. *Automata.*  Documents are dealt into shards of about SHARD_BYTES.
   Of each shard the confirmed phrases that its documents may hold are compiled
   into an Aho-Corasick automaton, through which all of its documents that
   aren't known to share nothing are streamed: it locates every occurrence.
4. *Owners.*  The windows for which a located phrase stands are consecutive:
   together they are a cell.  Cells of equal words (by a 128-bit BLAKE2b digest
   of their bytes) have equal windows, so all but the first owner's are
   repeats.  Windows of the first owners' cells meet once more, one by one, as
   cells of other words can share some.
5. *Removal.*  Each document drops the words that its repeated windows cover.

Every shard's automaton holds its own documents' phrases only: phrases grow with
the corpus, and all of them times all documents would grow with its square.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklume.llm import text as T
from tracklume.llm.columns import aside
from tracklume.llm.scratch import partitions
from tracklume.llm.shared_keys import KEY_ROWS, OWNER_ROWS, key_rows, owned, owner_rows, recurring

WINDOW, PHRASE = 13, 5
#: Bytes of the documents of one automaton's shard, about: it takes some 60 times as much for each of its phrases' bytes.
SHARD_BYTES = 1 << 20
#: A window's place and a number of windows in one value.
_COUNT_BITS = 16


def least_phrases(w: T.Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word from which a window starts, the least phrase hash in that window and the first place where it stands."""
    each = T.grams(w.hashes, phrase) >> np.uint64(1)
    least, at = each.copy(), np.arange(len(each))
    for i in range(1, min(window - phrase + 1, len(each))):
        less = np.flatnonzero(each[i:] < least[: len(each) - i])
        least[less], at[less] = each[less + i], less + i
    return least, at


def _flat(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts as bytes of single-spaced words, each word between spaces, each text ended by a line feed; where each word starts and ends."""
    parts, starts, ends = [], [], []
    at = 0
    for value in texts:
        found = (value.as_py() or "").encode().split()
        parts.append((b" " + b" ".join(found) if found else b"") + b" \n")
        stops = at + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        ends.append(stops)
        starts.append(np.r_[at, stops[:-1]] + 1 if len(found) else stops)
        at += len(parts[-1])
    return b"".join(parts), *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))


def located(flat: bytes, starts: np.ndarray, phrases: set[bytes]) -> np.ndarray:
    """The words of ``flat`` from which on one of ``phrases`` stands."""
    automaton = ahocorasick.Automaton()
    for x in phrases:
        automaton.add_word(f" {x.decode('latin-1')} ", len(x))
    automaton.make_automaton()
    found = np.fromiter((end - size for end, size in automaton.iter(flat.decode("latin-1"))), np.int64)
    return np.unique(np.searchsorted(starts, found))


def _near(starts: np.ndarray, n: int, before: int) -> np.ndarray:
    """True at each start and the ``before`` words ahead of it."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(starts - before, 0), 1)
    np.add.at(change, starts + 1, -1)
    return np.cumsum(change[:-1]) > 0


def _digests(flat: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of each span, as two columns."""
    found = b"".join(hashlib.blake2b(flat[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def kept_words(text: str | None, cells: list[int] | None, window: int) -> tuple[int, int, str]:
    """How many words, how many of them go, and what stays; ``cells`` are the places and numbers of repeated windows, or -1 for all."""
    found = (text or "").encode().split()
    if not cells or len(found) < window:
        return len(found), 0, b" ".join(found).decode()
    if -1 in cells:
        return len(found), len(found), ""
    values = np.array(cells, np.int64)
    at, count = values >> _COUNT_BITS, values & ((1 << _COUNT_BITS) - 1)
    change = np.zeros(len(found) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + count + window - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    kept = [x for x, g in zip(found, gone.tolist(), strict=True) if not g]
    return len(found), len(found) - len(kept), b" ".join(kept).decode()


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``docs`` (doc_id, text and any others) with n_words, n_removed and kept_text: the words no earlier document's windows cover, joined by spaces.

    A null text has no words.  A row of a null doc_id keeps all its words and
    owns none; rows of equal doc_ids take nothing from each other.  Texts under
    ``window`` words keep all.  Columns named like the results are replaced, all
    others stay.  Texts are shuffled once, by (doc_id, text hash), for all uses.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    own, names_back = aside(docs, "n_words", "n_removed", "kept_text")
    doc_column, text_column = (names_back[x] for x in ("doc_id", "text"))
    id_, sha = F.col(doc_column).cast("long"), F.sha2(F.coalesce(text_column, F.lit("")), 256)
    rows = own.withColumns({"_a": id_, "_b": F.xxhash64(sha).bitwiseAND((1 << 63) - 1)})
    known = rows.where("_a is not null")
    dealt = known.repartition(n, "_a", "_b")
    columns = dealt.columns
    text, a, b = (columns.index(x) for x in (text_column, "_a", "_b"))

    def beside(found: DataFrame) -> DataFrame:
        """All documents, with the array that ``found`` (a, b, x) has for some.  All columns go along: so all uses of ``dealt`` are one exchange."""
        lists = found.groupBy("a", "b").agg(F.collect_set("x").alias("x"))
        return dealt.join(lists.hint("shuffle_hash"), (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")), "left").select(*columns, "x")

    def told(batches: Iterator[pa.RecordBatch], size: int = T.CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
        """The chunks of documents that have an array, and those arrays."""
        for batch in batches:
            some = batch.filter(batch.column(len(columns)).is_valid())
            for chunk in T.chunks(iter([some]), text_column, size):
                if chunk.num_rows:
                    yield chunk, chunk.column(len(columns))

    def names(chunk: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return chunk.column(a).to_numpy(), chunk.column(b).to_numpy()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in T.chunks(batches):
            _, once = np.unique(chunk.column(0).to_numpy(), return_index=True)
            part = chunk.take(pa.array(np.sort(once)))
            w = T.words(part.column(1))
            least, at = least_phrases(w, window, phrase)
            starts = T.whole(w, window)
            chosen = starts & ~np.r_[False, (at[1:] == at[:-1]) & starts[:-1]] if len(at) else starts
            yield key_rows(least[chosen], part.column(0).to_numpy()[w.doc[chosen]])

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases of shared hashes, by their words; of those that more than two texts of the chunk have, the inner ones come as told."""
        for chunk, keys in told(batches):
            w = T.words(chunk.column(text))
            flat, starts, ends = _flat(chunk.column(text))
            least, at = least_phrases(w, window, phrase)
            shared = np.unique(pa.ListArray.flatten(keys).to_numpy())
            places = np.unique(at[T.whole(w, window) & np.isin(least.astype(np.int64), shared)])
            ids, texts = (x[w.doc[places]].tolist() for x in names(chunk))
            holders: dict[bytes, dict[int, int]] = defaultdict(dict)
            for s, e, i, x in zip(starts[places].tolist(), ends[places + phrase - 1].tolist(), ids, texts, strict=True):
                holders[flat[s:e]][x] = i
            out: list[tuple[bytes, bytes | None, int, int]] = []
            for words, found in holders.items():
                outer = min(found), max(found)
                out += [(words, None, i, x) if x in outer else (b" %d" % x, words, i, x) for x, i in found.items()]
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["x", "told", "a", "b"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, lists in told(batches, SHARD_BYTES):
            w = T.words(chunk.column(text))
            flat, starts, ends = _flat(chunk.column(text))
            found = np.zeros(len(w.hashes) + 1, bool)
            found[located(flat, starts, set(pa.ListArray.flatten(lists).to_pylist()))] = True
            _, at = least_phrases(w, window, phrase)
            inside = T.whole(w, window) & found[at]
            first = np.flatnonzero(inside & ~np.r_[False, inside[:-1] & (at[1:] == at[:-1])])
            last = np.flatnonzero(inside & ~np.r_[inside[1:] & (at[1:] == at[:-1]), False])
            keys = _digests(flat, starts[first], ends[last + window - 1])
            (ids, hashes), doc = names(chunk), w.doc[first]
            yield owner_rows(keys, ids[doc], hashes[doc], (first - w.first[doc]) << _COUNT_BITS | (last - first + 1))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, lists in told(batches):
            w = T.words(chunk.column(text))
            flat, starts, ends = _flat(chunk.column(text))
            values = pa.ListArray.flatten(lists).to_numpy()
            doc = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy())
            count = values & ((1 << _COUNT_BITS) - 1)
            doc, first = np.repeat(doc, count), np.repeat(w.first[doc] + (values >> _COUNT_BITS), count)
            at = first + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
            ids, hashes = names(chunk)
            yield owner_rows(_digests(flat, starts[at], ends[at + window - 1]), ids[doc], hashes[doc], (at - w.first[doc]) << _COUNT_BITS | 1)

    # Equal texts, by SHA-256: the smallest doc_id stands for all, and the others repeat it.
    same = known.select("_a", "_b", F.unhex(sha).alias("sha"))
    texts = same.groupBy("sha").agg(F.min("_a").alias("a"), F.min("_b").alias("b"))
    copies = same.join(texts.select("sha", "a"), "sha").where("_a > a").select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.lit(-1).cast("long").alias("x"))

    shared = recurring(known.select("_b", F.col(text_column).alias("text")).mapInArrow(keyed, KEY_ROWS)).withColumnRenamed("owner", "b")
    phrases = beside(shared.join(texts.select("a", "b"), "b").select("a", "b", F.col("key").alias("x"))).mapInArrow(spoken, "x binary, told binary, a long, b long")
    group = Window.partitionBy("x")
    met = phrases.repartition(n, "x").select("*", F.min("b").over(group).alias("low"), F.max("b").over(group).alias("high")).where("low <> high or told is not null")
    confirmed = met.select("a", "b", F.coalesce("told", "x").alias("x"))
    repeated = owned(beside(confirmed).mapInArrow(cells, OWNER_ROWS))
    single = owned(beside(repeated.where("not later").select("a", "b", F.explode("vs").alias("x"))).mapInArrow(windows, OWNER_ROWS))
    later = repeated.union(single).where("later").select("a", "b", F.explode("vs").alias("x"))
    joined = beside(later.union(copies))
    everything = joined.unionByName(rows.where("_a is null").withColumn("x", F.lit(None).cast("array<long>")))

    kept = list(names_back.values())
    place = kept.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [kept_words(t.as_py(), p.as_py(), window) for t, p in zip(batch.column(place), batch.column(len(kept)), strict=True)]
            columns = [pa.array([r[i] for r in results], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, "n_words", "n_removed", "kept_text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields), "n_words long, n_removed long, kept_text string"])
    return everything.select(*kept, "x").mapInArrow(run, schema).toDF(*names_back, "n_words", "n_removed", "kept_text")
