"""Conversations mended by the cheapest edits: Dijkstra over the lattice of turns and grammar states.

A node of the lattice is (turns read, state of the grammar of role initials
``(s?(ua)+)?``).  An edge reads a turn - Keep, Rerole, Delete - or Inserts an
empty one.  The queue is ordered by (cost, audit), audit being the initials of
the edits so far; the first accepting end node that leaves it is the cheapest
repair, of equally cheap ones the ASCII-least.  Nodes exist only while the
search looks at them.

Of two ways to one node of equal cost neither audit begins the other (what
came behind it would be inserts, which cost), so the lesser stays the lesser
whatever follows, and the search may forget the other.

A conversation of any length passes through in blocks of BLOCK turns: the best
ways to a block's last nodes begin the next one, the edits that they have in
common are final, and their turns go out.  Its rows are one sorted group, as
the hash of a whole repaired conversation is; what a task holds is a block and
the turns that aren't final.  What needs no order is worked out before, by
Spark: damage, blanks, cut ends, and which turns were seen earlier.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.llm import text as T
from tracklume.llm.scratch import partitions

BLOCK = 256
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: 0 nothing kept, 1 after system, 2 after user, 3 after assistant; each initial's next state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Where a turn of the role that fits, user or assistant, leads.
FITTING = (2, 2, 3, 2)
ACCEPTING = (0, 3)
LEGAL = {"su", "ua", "au"}
_BLANKS = " \t\n\x0b\x0c\r"


class Turn(NamedTuple):
    role: str
    text: str
    must_go: bool
    truncated: bool


def search(sources: dict[int, tuple[int, str]], turns: list[Turn], last: bool) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the best way to each state behind ``turns``, from those of ``sources``; if ``last``, of the best accepting one alone."""
    queue = [(cost, audit, 0, state) for state, (cost, audit) in sources.items()]
    heapq.heapify(queue)
    done, ends = set(), {}
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(turns):
            if last and state in ACCEPTING:
                return {state: (cost, audit)}
            ends[state] = (cost, audit)
        else:
            turn = turns[at]
            heapq.heappush(queue, (cost + DELETE, audit + "D", at + 1, state))
            if not turn.must_go:
                extra = cost + TRUNCATED * turn.truncated
                heapq.heappush(queue, (extra + REROLE, audit + "R", at + 1, FITTING[state]))
                if (kept := NEXT[state].get(turn.role[:1])) is not None:
                    heapq.heappush(queue, (extra, audit + "K", at + 1, kept))
        heapq.heappush(queue, (cost + INSERT, audit + "I", at, FITTING[state]))
    return ends


def worth(ends: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """Without the ways that have kept no user turn and cost so much that one that has is cheaper whatever follows.

    From state 3 all that follows states 0 or 1 can follow too, if a system
    turn is deleted (4) instead of kept; from state 2 after one insert (3) more.
    """
    bound = min((ends[s][0] + more for s, more in ((3, DELETE), (2, DELETE + INSERT)) if s in ends), default=None)
    return {s: way for s, way in ends.items() if s > 1 or bound is None or way[0] <= bound}


class Repair:
    """One conversation's turns, fed in order; ``out`` gets (edit, role, text) of each turn that stays."""

    def __init__(self, out: Callable[[str, str, str], None]):
        self.out, self.state, self.done = out, 0, []
        self.ways: dict[int, tuple[int, str]] = {0: (0, "")}
        self.waiting: deque[Turn] = deque()
        self.block: list[Turn] = []

    def feed(self, turn: Turn) -> None:
        self.waiting.append(turn)
        self.block.append(turn)
        if len(self.block) == BLOCK:
            self._advance(False)

    def finish(self) -> tuple[int, str]:
        """The cost, and the audit."""
        self._advance(True)
        (cost, _), *_ = self.ways.values()
        return cost, "".join(self.done)

    def _advance(self, last: bool) -> None:
        ways = search(self.ways, self.block, last)
        ways = ways if last else worth(ways)
        final = os.path.commonprefix([audit for _, audit in ways.values()])
        for edit in final:
            self._apply(edit)
        self.done.append(final)
        self.ways = {s: (cost, audit[len(final) :]) for s, (cost, audit) in ways.items()}
        self.block = []

    def _apply(self, edit: str) -> None:
        turn = Turn("", "", False, False) if edit == "I" else self.waiting.popleft()
        if edit == "D":
            return
        role = turn.role if edit == "K" else "assistant" if FITTING[self.state] == 3 else "user"
        self.state = NEXT[self.state][role[0]]
        self.out(edit, role, turn.text)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with null roles and texts as one space, damaged by crc32(``conv_id:turn``) % 20; ``there`` is false for what was dropped."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", name("conv_id"), name("turn")).cast("binary")) % 20
    told = rows.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    there, role = F.col("kind") != 0, F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    one = told.select("conv_id", "turn", F.when(there, role).alias("role"), F.when(there, text).alias("text"), there.alias("there"), F.explode(copies).alias("copy"))
    return one.drop("copy")


def _marks(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, there) with blank, truncated, ``key`` (128 bits of SHA-256 of conversation, role and text) and later: whether the key has an earlier turn."""
    solid = F.rtrim("text", F.lit(_BLANKS))
    whose = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    key = F.sha2(F.concat_ws(":", F.col("conv_id").isNull(), whose, F.char_length("role"), "role", "text"), 256)
    keyed = rows.withColumn("key", F.when(F.col("there"), F.substring(F.unhex(key), 1, 16)))
    often = keyed.where("there").groupBy("key").agg(F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("unknown"), F.count("*").alias("times")).where("times > 1").drop("times")
    met = keyed.join(often, "key", "left")
    # Null turns come before all others.
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("unknown") | (F.col("turn") > F.col("first"))), F.lit(False))
    return met.select("conv_id", "turn", "role", "text", "there", (solid == "").alias("blank"), (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "key", later.alias("later"))


class Conversation:
    """What is counted of one conversation, and its repair."""

    def __init__(self, conv_id: int | None, out: Callable[[str, str, str], None]):
        self.conv_id, self.repair = conv_id, Repair(out)
        self.low = self.high = self.turn = self.key = self.initial = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def feed(self, turn: int | None, role: str, text: str, blank: bool, truncated: bool, key: bytes, later: bool) -> None:
        if turn is not None:
            self.distinct += self.turn != turn or self.low is None
            self.low, self.high = turn if self.low is None else self.low, turn
        # Rows of one turn are sorted by role and text: an equal row is the one before.
        duplicate = not blank and (later or key == self.key)
        truncated = not blank and not duplicate and truncated
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += self.initial is not None and self.initial + role[:1] not in LEGAL
        self.turn, self.key, self.initial = turn, key, role[:1]
        self.repair.feed(Turn(role, text, blank or duplicate, truncated))

    def finish(self) -> tuple:
        cost, audit = self.repair.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _conversations(batches: Iterator[pa.RecordBatch], out: Callable[[int | None], Callable[[str, str, str], None]]) -> Iterator[tuple | None]:
    """The counts of each conversation of the sorted rows when it ends; None after each chunk of them."""
    now = None
    for batch in T.chunks(batches):
        conv_ids, turns, roles, texts, there, *marks = (c.to_pylist() for c in batch.columns)
        for i, conv_id in enumerate(conv_ids):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now.finish()
                now = Conversation(conv_id, out(conv_id))
            if there[i]:
                now.feed(turns[i], roles[i], texts[i], *(m[i] for m in marks))
        yield None
    if now is not None:
        yield now.finish()


COUNTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "conv_id long, position long, edit string, role string, text string"


def _sorted(rows: DataFrame) -> DataFrame:
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    told = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", "there")
    return _marks(told).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order)


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, position (from 0), edit (K, R or I), role and text of every turn of every repaired conversation.

    ``rows`` has conv_id, turn, role, text and there, as ``damaged`` gives
    them: rows that aren't there only name their conversation.  Rows go by
    turn, null ones first, rows of one turn by role and text.  A null conv_id
    is a conversation of its own; an empty role fits nowhere and is reroled or
    deleted.  Other columns are not read; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(conv_id: int | None) -> Callable[[str, str, str], None]:
            count = iter(range(1 << 62))
            return lambda edit, role, text: held.append((conv_id, next(count), edit, role, text))

        for _ in _conversations(batches, out):
            if len(held) >= 1000:
                yield _arrow(held, TURNS)
                held.clear()
        yield _arrow(held, TURNS)

    return _sorted(rows).mapInArrow(run, TURNS)


def repairs(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``rows`` (see ``repaired_turns``): faults, cost, audit, and repaired_sha256 of its repaired ``role:text``, joined by line feeds.

    gaps counts the turns that are missing between the least and the greatest;
    blank, duplicate and truncated each row's first fault; illegal the
    neighbours whose role initials are not su, ua or au.  A conversation
    without rows has zeros, an empty audit and the hash of the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, fresh, held = hashlib.sha256(), True, []

        def out(conv_id: int | None) -> Callable[[str, str, str], None]:
            nonlocal digest, fresh
            digest, fresh = hashlib.sha256(), True

            def hash_turn(edit: str, role: str, text: str) -> None:
                nonlocal fresh
                digest.update(("" if fresh else "\n").encode() + f"{role}:{text}".encode())
                fresh = False

            return hash_turn

        for found in _conversations(batches, out):
            if found is not None:
                held.append((*found, digest.hexdigest()))
            elif len(held) >= 1000:
                yield _arrow(held, f"{COUNTS}, repaired_sha256 string")
                held.clear()
        yield _arrow(held, f"{COUNTS}, repaired_sha256 string")

    return _sorted(rows).mapInArrow(run, f"{COUNTS}, repaired_sha256 string")
