"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets whose Jaccard similarity reaches t share a token among the first
n - ceil(t n) + 1 of each, under any order of all tokens.  Three orders are
used: the first puts frequent tokens last, so that common passages make no
candidates; the others are by two hashes.  Candidates are documents that share
a prefix token under the first order, at places that leave enough after them;
of these, the ones stay that share prefix tokens under both other orders too
and whose bitmaps (a bit for every token's hash) allow the similarity.  Only
then are texts fetched, and compared word by word.

Documents of equal words are one node.  Of the holders of a token the one is
its pivot whose prefix is shared most with others, which in a group of near
copies is the one of fewest own words; every node is compared with the pivots
that share most tokens with it, which links most groups.  Pivots have then met
all holders and leave the token, and while that still saves comparisons, the
next ones take their place.  Last, all pairs that share a token and aren't in
one component are compared: no link between components is lost, and large
groups of near copies don't become all their pairs.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.llm import text as T
from tracklume.llm.components import components
from tracklume.llm.scratch import Scratch
from tracklume.llm.shared_keys import KEY_VALUE_ROWS, key_rows, recurring

#: Frequent tokens, at most, by which every task orders: which are known changes the candidates, not what is linked.
MAX_FREQUENT = 1 << 19
#: Tokens that a task counts together, and documents among them from which on a token may be frequent.
COUNTED_TOGETHER, FREQUENT_AMONG = 1 << 21, 4
#: Seeds of the token orders.
ORDERS = (1, 2, 3)
#: Bytes of text whose sets are made at a time: their arrays are some twenty times as large.
SET_BYTES = 1 << 20
#: Bits of the filter that leaves most texts out before those of candidates are shuffled; when it is full, all are.
FETCH_BITS = 1 << 23
#: Rounds of pivots go on while pairs that are left are more than so many times the rows they come from, and a round takes away at least this share.
PAIRS_A_ROW, LEAST_GAIN = 2, 0.2
_TOP = np.uint64(1 << 62)


class Sets(NamedTuple):
    """Of each text its distinct tokens (63 bits), sorted: tokens[first[i] : first[i + 1]]."""

    tokens: np.ndarray
    first: np.ndarray

    def spans(self) -> Iterator[tuple[int, int]]:
        return zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)


class Frequent(NamedTuple):
    """Frequent tokens in order of value, and how frequent each is: a binary digit more for twice as many documents."""

    tokens: np.ndarray
    level: np.ndarray


def _distinct(tokens: np.ndarray, doc: np.ndarray, n: int) -> Sets:
    order = np.lexsort((tokens, doc))
    tokens, doc = tokens[order], doc[order]
    fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])] if len(tokens) else np.zeros(0, bool)
    return Sets(tokens[fresh], np.searchsorted(doc[fresh], np.arange(n + 1)))


def shingle_sets(texts: pa.Array, n: int) -> Sets:
    """The distinct n-word shingles of A-Z lower-cased texts, hashed; a shorter text is one shingle."""
    w = T.words(texts, lower=True)
    whole = T.whole(w, n)
    tokens, doc = T.grams(w.hashes, n)[whole], w.doc[whole]
    count = np.diff(w.first)
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        if len(short):
            tokens = np.concatenate([tokens, T.mix(T.grams(w.hashes, size)[w.first[short]] + np.uint64(size))])
            doc = np.concatenate([doc, short])
    return _distinct(tokens >> np.uint64(1), doc, len(texts))


def exact_sets(texts: pa.Array, n: int) -> Sets:
    """As ``shingle_sets``, with numbers that are equal for equal words only, for the texts of one array."""
    w = T.words(texts, lower=True)
    ids, count = T.exact_ids(w), np.diff(w.first)
    tokens, doc, at = [], [], 0
    for size in range(1, n + 1):
        if size > 1:  # (the words so far, the next word) as one number
            pairs = ids[: len(ids) - 1] * np.int64(len(single) + len(w.hashes) + 1) + single[size - 1 :][: len(ids) - 1]
            _, ids = np.unique(pairs, return_inverse=True)
        else:
            _, ids = np.unique(ids, return_inverse=True)
            single = ids
        starts = w.first[:-1][count == size] if size < n else np.flatnonzero(T.whole(w, n))
        if len(starts):
            tokens.append(ids[starts] + at)
            doc.append(w.doc[starts])
        at += len(w.hashes) + 1
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return _distinct(join(tokens), join(doc), len(texts))


def _keep(n: int, percent: int) -> int:
    """Tokens of a prefix."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def prefixes(sets: Sets, percent: int, seed: int, frequent: Frequent | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, place in the set's order) of the prefix tokens of each set, by a hash of ``seed``; frequent ones last, by level.

    A key is a hash of 63 bits: tokens that share one only make more candidates.
    """
    key = T.mix(sets.tokens + np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64))) >> np.uint64(2)
    if frequent is not None and len(frequent.tokens) and len(key):
        at = np.minimum(np.searchsorted(frequent.tokens, sets.tokens), len(frequent.tokens) - 1)
        known = frequent.tokens[at] == sets.tokens
        key[known] = _TOP | (frequent.level[at[known]] << np.uint64(56)) | (key[known] >> np.uint64(6))
    parts, sizes = [], []
    for a, b in sets.spans():
        keep = _keep(b - a, percent)
        parts.append(np.sort(np.partition(key[a:b], keep - 1)[:keep]) if keep else key[a:a])
        sizes.append(keep)
    text = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes if sizes else np.zeros(0, int)
    return np.concatenate(parts) if parts else key, text, (np.arange(len(text)) - starts[text]).astype(np.uint32)


def digests(texts: pa.Array) -> list[bytes]:
    """128 bits of SHA-256 of each text's lower-cased words: texts of equal ones are taken for equal."""
    return [hashlib.sha256(b" ".join((x.as_py() or "").encode().translate(T.LOWER).split())).digest()[:16] for x in texts]


def node_ids(found: list[bytes], taken: dict[bytes, int], bits: int) -> np.ndarray:
    """A number below 2^63 for each digest: its first bits, or what ``taken`` says."""
    return np.array([taken.get(x, int.from_bytes(x[:8], "big") >> (64 - bits)) for x in found], np.int64)


def profiles(sets: Sets, percent: int) -> list[bytes]:
    """Of each set 32 bits of every prefix token under the other orders: both in order, of one length."""
    parts = []
    for seed in ORDERS[1:]:
        key, text, _ = prefixes(sets, percent, seed)
        cuts = np.searchsorted(text, np.arange(len(sets.first)))
        parts.append(((key & np.uint64(0xFFFFFFFF)).astype(np.uint32), cuts.tolist()))
    (p, a), (q, b) = parts
    return [p[a[i] : a[i + 1]].tobytes() + q[b[i] : b[i + 1]].tobytes() for i in range(len(sets.first) - 1)]


def meet_everywhere(x: bytes, y: bytes) -> bool:
    """Whether two profiles share prefix tokens under each of the orders."""
    a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    n, m = len(a) // 2, len(b) // 2
    return np.isin(a[:n], b[:m]).any() and np.isin(a[n:], b[m:]).any()


def bitmaps(sets: Sets) -> list[bytes]:
    """Of each set a bit for every token's hash, in twice as many bits as tokens, up to a power of two."""
    out = []
    for a, b in sets.spans():
        size = max(64, 1 << (2 * (b - a) - 1).bit_length()) if b > a else 64
        bits = np.zeros(size, bool)
        bits[(sets.tokens[a:b] & np.uint64(size - 1)).astype(np.int64)] = True
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return out


def may_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m tokens with these bitmaps can reach the similarity.

    A bit that only one has is a token, at least, that the other hasn't.  The
    longer bitmap is folded: its halves are of the same hashes but for a bit.
    """
    a, b, size = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * min(len(x), len(y))
    for _ in range(8 * len(x) // size - 1):
        a = a & (1 << size) - 1 | a >> size
    for _ in range(8 * len(y) // size - 1):
        b = b & (1 << size) - 1 | b >> size
    both = min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count())
    return 100 * both >= percent * (n + m - both)


def _meet(a: np.ndarray, b: np.ndarray) -> int:
    """How many tokens two sets of distinct ones share."""
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def linked(x_texts: pa.Array, y_texts: pa.Array, n: int, percent: int) -> np.ndarray:
    """Which pairs of texts reach the similarity, by their words."""
    count = len(x_texts)
    sets = exact_sets(pa.concat_arrays([x_texts, y_texts]), n)
    spans, found = list(sets.spans()), np.zeros(count, bool)
    for k in range(count):
        (a, b), (c, d) = spans[k], spans[count + k]
        both = _meet(sets.tokens[a:b], sets.tokens[c:d])
        found[k] = both > 0 and 100 * both >= percent * (b - a + d - c - both)
    return found


_SIGNATURE = "doc_id long, n long, digest binary, node long, bits binary, profile binary, tokens binary, counts binary"
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), *[pa.binary()] * 4]
_NAMES = ["doc_id", "n", "digest", "node", "bits", "profile", "tokens", "counts"]


def signatures(texts: DataFrame, n: int, percent: int, id_bits: int) -> DataFrame:
    """A row a text: size, digest, bitmap and profile of its set; and rows of tokens that a task counted often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(seen), return_counts=True)
            often = counts >= FREQUENT_AMONG
            seen.clear()
            row = [*[None] * 6, tokens[often].tobytes(), counts[often].astype(np.int64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS, strict=True)], names=_NAMES)

        for chunk in T.chunks(batches, size=SET_BYTES):
            sets, names = shingle_sets(chunk.column(1), n), digests(chunk.column(1))
            seen.append(sets.tokens)
            none = [None] * chunk.num_rows
            columns = [chunk.column(0), np.diff(sets.first), names, node_ids(names, {}, id_bits), bitmaps(sets), profiles(sets, percent), none, none]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)
            if sum(map(len, seen)) >= COUNTED_TOGETHER:
                yield counted()
        if seen:
            yield counted()

    return texts.mapInArrow(run, _SIGNATURE)


def frequent_tokens(counted: DataFrame) -> Frequent:
    """At most MAX_FREQUENT tokens of most documents, from the counts of all tasks; a token that no task saw often is not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, counts in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64)) for x in (tokens, counts)], names=["token", "n"])

    rows = counted.where("tokens is not null").select("tokens", "counts").mapInArrow(run, "token long, n long")
    top = rows.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toPandas()
    tokens, level = top["token"].to_numpy(np.int64).view(np.uint64), np.frexp(top["n"].to_numpy(float))[1].astype(np.uint64)
    order = np.argsort(tokens)
    return Frequent(tokens[order], level[order])


def taken_ids(signed: DataFrame, id_bits: int) -> dict[bytes, int]:
    """Digests whose first bits another digest has too, but for one of each, with ids of their own; hardly ever any."""
    rows = signed.groupBy("node").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("node", "low")
    found = signed.join(rows, "node").where("digest <> low").select("digest").distinct().collect()
    return {bytes(r["digest"]): int.from_bytes(hashlib.sha256(b"again" + r["digest"]).digest()[:8], "big") >> 1 for r in found}


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_bits: int = 63) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Two documents link where 100 |A and B| >= percent |A or B| for their sets
    of n-word shingles; component_id is the smallest doc_id that links reach.
    A null text or one without words has an empty set and is linked with
    nothing; a null doc_id belongs to the component of its set.  Rows of one
    doc_id are each judged by their own text.  Columns beside these are left
    out.  ``id_bits`` of a digest number the nodes; equal ones are told apart.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.write(signatures(texts, n, percent, id_bits), "signatures")
    frequent = spark.sparkContext.broadcast(frequent_tokens(signed))
    signed = signed.where("node is not null")
    if taken := taken_ids(signed, id_bits):
        other = spark.createDataFrame(pa.table({"digest": pa.array(taken.keys(), pa.binary()), "other": pa.array(taken.values(), pa.int64())}))
        signed = signed.join(F.broadcast(other), "digest", "left").withColumn("node", F.coalesce("other", "node")).drop("other")
    nodes = signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in T.chunks(batches, size=SET_BYTES):
            found = digests(chunk.column(1))
            _, once = np.unique(np.array(found, "S16"), return_index=True)
            part = chunk.take(pa.array(np.sort(once)))
            sets, ids = shingle_sets(part.column(1), n), node_ids([found[i] for i in np.sort(once)], taken, id_bits)
            key, text, place = prefixes(sets, percent, ORDERS[0], frequent.value)
            yield key_rows(key, ids[text], place.astype(np.int64) << 32 | np.diff(sets.first)[text])

    shared = recurring(texts.mapInArrow(marked, KEY_VALUE_ROWS)).select("key", F.col("owner").alias("node"), F.shiftright("v", 32).alias("at"), F.col("v").bitwiseAND(0xFFFFFFFF).alias("n")).distinct()
    shared = scratch.write(shared, "shared")
    held = signed.select("node", "bits", "profile").join(shared.select("node").distinct(), "node", "left_semi")
    hints = scratch.write(held.groupBy("node").agg(F.first("bits").alias("bits"), F.first("profile").alias("profile")), "hints")

    def possible(pairs: DataFrame) -> DataFrame:
        """The pairs (x, n, y, m) that meet under the other orders and whose bitmaps let them link."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True)
                keep = pa.array([meet_everywhere(p, q) and may_link(b, c, i, j, percent) for b, c, i, j, p, q in rows], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["x", "y"])

        left = hints.select(F.col("node").alias("x"), F.col("bits").alias("x_bits"), F.col("profile").alias("x_profile"))
        right = hints.select(F.col("node").alias("y"), F.col("bits").alias("y_bits"), F.col("profile").alias("y_profile"))
        return pairs.join(left, "x").join(right, "y").select("x", "y", "x_bits", "y_bits", "n", "m", "x_profile", "y_profile").mapInArrow(run, "x long, y long")

    def fetched(pairs: DataFrame, name: str) -> DataFrame:
        """(node, text) of the nodes of ``pairs``; a filter of bounded size leaves most other texts out before the join."""
        wanted = scratch.write(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct().join(nodes, "node").select("node", "rep"), f"{name}-wanted")
        place = F.pmod(F.xxhash64("rep"), F.lit(FETCH_BITS))
        found = wanted.groupBy(F.floor(place / 32).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(pmod(xxhash64(rep), {FETCH_BITS}), 32)))")).alias("bits")).toPandas()
        table = np.zeros(FETCH_BITS // 32, np.uint64)
        table[found["word"].to_numpy(int)] = found["bits"].to_numpy(np.int64).astype(np.uint64)
        table = spark.sparkContext.broadcast(table)

        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(2).to_numpy()
                hit = table.value[at // 32] >> (at % 32).astype(np.uint64) & np.uint64(1)
                part = batch.filter(pa.array(hit.astype(bool)))
                yield pa.RecordBatch.from_arrays([pa.array(node_ids(digests(part.column(1)), taken, id_bits)), part.column(0), part.column(1)], names=["node", "rep", "text"])

        placed = texts.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(FETCH_BITS)))
        sifted = placed.mapInArrow(sift, "node long, rep long, text string")
        same = (F.col("texts.node") == F.col("wanted.node")) & F.col("texts.rep").eqNullSafe(F.col("wanted.rep"))  # all ids of a node can be null
        return scratch.write(sifted.alias("texts").join(wanted.alias("wanted"), same, "left_semi").dropDuplicates(["node"]).select("node", "text"), f"{name}-texts")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.write(possible(pairs), f"{name}-pairs")
        held = fetched(pairs, name)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in T.chunks(batches):
                found = pa.array(linked(chunk.column(2), chunk.column(3), n, percent))
                yield pa.RecordBatch.from_arrays([chunk.column(0).filter(found), chunk.column(1).filter(found)], names=["x", "y"])

        left = held.select(F.col("node").alias("x"), "text")
        right = held.select(F.col("node").alias("y"), F.col("text").alias("y_text"))
        links = scratch.write(pairs.join(left, "x").join(right, "y").select("x", "y", "text", "y_text").mapInArrow(run, "x long, y long"), f"{name}-links")
        scratch.drop(f"{name}-texts")
        scratch.drop(f"{name}-pairs")
        return links

    # The sizes n and m, and the places of a token that both have: what follows it in either bounds what they have in common.
    most = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("by"))
    near = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (most * 100 >= (F.col("n") + F.col("m") - most) * percent)
    # A node's rank is how much of its prefix others share, then its number.
    keep = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    ranks = shared.groupBy("node").agg(F.floor(F.count("*") / F.max(keep) * (1 << 14)).alias("share"))
    ranks = ranks.select("node", F.shiftleft("share", 48).bitwiseOR(F.shiftright("node", 15)).alias("rank"))
    open_ = scratch.write(shared.join(ranks, "node").select("key", "node", "n", "at", "rank", F.col("node").alias("label")), "open-0")
    as_y = [F.col("node").alias("y"), F.col("n").alias("m"), F.col("at").alias("by"), F.col("label").alias("other")]
    labels = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("label"))
    before = float("inf")

    def joined(found: DataFrame, name: str) -> DataFrame:
        """Labels with what is linked by ``found`` (x, n, y, m) put together."""
        links = labels.select(F.col("node").alias("x"), F.col("label").alias("y")).union(verify(found, name))
        return scratch.write(components(links, scratch, name), f"{name}-labels")

    for step in itertools.count(1):
        ranked = open_.join(open_.groupBy("key").agg(F.max("rank").alias("top")), "key")
        pivots = ranked.where("rank = top").select("key", *as_y)
        beside = open_.withColumnRenamed("node", "x").join(pivots, "key").where((F.col("x") != F.col("y")) & (F.col("label") != F.col("other")) & near)
        labels = joined(beside.select("x", "n", "y", "m").distinct(), f"round-{step}")
        rest = ranked.where("rank < top").drop("label", "top").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        counts = rest.groupBy("key", "label").agg(F.count("*").alias("c"))
        several = counts.groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("squares")).where("c * c > squares")
        open_ = scratch.write(rest.join(several.select("key"), "key").select(open_.columns), f"open-{step}")
        counts = open_.groupBy("key", "label").agg(F.count("*").alias("c"))
        found = counts.groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("squares"))
        rows, left = found.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c").cast("double") * F.col("c") - F.col("squares")) / 2), F.lit(0.0))).first()
        if left <= PAIRS_A_ROW * rows or left > (1 - LEAST_GAIN) * before:
            break
        before = left
    if rows:
        pairs = open_.withColumnRenamed("node", "x").join(open_.select("key", *as_y), "key").where((F.col("label") < F.col("other")) & near)
        labels = joined(pairs.select("x", "n", "y", "m").distinct(), "rest")

    whole = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    least = whole.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = whole.join(least, "label").select("node", "component_id")
    told = signed.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    told = told.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return scratch.keep(told, "result")
