"""Repairs of conversations against all edits of short ones, a table of all nodes of long ones, and plain damage."""

import hashlib
import itertools
import random
import re
import zlib

import pandas as pd
import pytest

from tracklume.llm import conversations as C
from tracklume.llm import registry

SF = "/root/testdata/sf0.01"
ROWS = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def plain_faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def mend(turns, audit):
    """The repaired turns by an audit, or None where it isn't one."""
    out, left = [], list(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else left.pop(0)[1:]
        if edit in "RI":
            role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit != "D":
            out.append((role, text))
    whole = not left and "" not in [r for r, _ in out] and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return out if whole else None


def cost(faults, audit):
    left, total = list(faults), 0
    for edit in audit:
        fault = left.pop(0) if edit != "I" else ""
        if edit != "D" and fault in ("blank", "duplicate"):
            return None
        total += {"K": 0, "R": 3, "D": 4, "I": 3}[edit] + 3 * (fault == "truncated" and edit != "D")
    return total


def all_edits(turns, faults):
    """The least (cost, audit) of all edits with at most two inserts at a place."""
    best = None
    for gaps in itertools.product(("", "I", "II"), repeat=len(turns) + 1):
        for edits in itertools.product("KRD", repeat=len(turns)):
            audit = gaps[0] + "".join(e + g for e, g in zip(edits, gaps[1:], strict=True))
            price = cost(faults, audit)
            if price is not None and (best is None or (price, audit) < best) and mend(turns, audit) is not None:
                best = (price, audit)
    return best


def all_nodes(turns, faults):
    """The least (cost, audit) by relaxing every node of the lattice, turn by turn."""
    best = {0: (0, "")}
    for i in range(len(turns) + 1):
        for _ in range(3):
            for state, (price, audit) in list(best.items()):
                to = C.FITTING[state]
                best[to] = min(best.get(to, (1 << 60, "")), (price + 3, audit + "I"))
        if i == len(turns):
            return min(best[s] for s in (0, 3) if s in best)
        nodes, role = {}, turns[i][1]
        for state, (price, audit) in best.items():
            for edit, to in (("K", C.NEXT[state].get(role[:1])), ("R", C.FITTING[state]), ("D", state)):
                step = cost([faults[i]], edit)
                if to is not None and step is not None:
                    nodes[to] = min(nodes.get(to, (1 << 60, "")), (price + step, audit + edit))
        best = nodes


def wanted(conv, turns, best):
    faults = plain_faults(turns)
    price, audit = best(turns, faults)
    known = {t for t, _, _ in turns if t is not None}
    initials = [r[:1] for _, r, _ in turns]
    text = "\n".join(f"{r}:{t}" for r, t in mend(turns, audit))
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (conv, max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, price, audit, hashlib.sha256(text.encode()).hexdigest())


def made(own, conv, n):
    roles, texts = ["system", "user", "assistant", "tool", "", None, "user", "assistant"], ["Hi.", "What? ", "and", "", " \t", None, "é!\n", "Yes.", "no", "?"]
    return [(conv, own.choice([None, own.randrange(2 * n)]) if own.random() < 0.3 else i, own.choice(roles), own.choice(texts)) for i in range(n)]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_all_edits(spark):
    own = random.Random(11)
    rows = [r for conv in range(60) for r in made(own, conv, own.randint(1, 4))] + [(None, None, None, None), (None, 1, "user", "Who?"), (77, None, "user", "a."), (77, None, "user", "a.")]
    found = C.repairs(C.damaged(spark.createDataFrame([(*r, 0) for r in rows], f"{ROWS}, later int"))).collect()
    convs = {k: v for k, v in plain_damage(rows).items() if len(v) <= 4}
    assert [tuple(r) for r in order(found) if r[0] in convs] == order(wanted(k, v, all_edits) for k, v in convs.items())


@pytest.mark.parametrize("block", [1, 2, 7, 256])
def test_long_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    own = random.Random(block)
    for _ in range(60):
        turns = [(i, r or " ", t or " ") for i, (_, _, r, t) in enumerate(made(own, 0, own.randint(0, 60)))]
        faults, out = plain_faults(turns), []
        repair = C.Repair(lambda edit, role, text, out=out: out.append((role, text)))
        for (_, role, text), fault in zip(turns, faults, strict=True):
            repair.feed(C.Turn(role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        found = repair.finish()
        assert found == all_nodes(turns, faults)
        assert out == mend(turns, found[1])


def test_one_conversation_of_many_turns(spark):
    """What isn't final stays short: so a conversation's turns don't gather."""
    own, waiting = random.Random(1), []
    repair = C.Repair(lambda *_: None)
    for i in range(20_000):
        repair.feed(C.Turn(own.choice(["user", "assistant"]), "x", own.random() < 0.05, own.random() < 0.1))
        waiting.append(len(repair.waiting))
    assert len(repair.finish()[1]) >= 20_000 and max(waiting) < 4 * C.BLOCK


@pytest.mark.parametrize("sf", [SF, SF.replace("0.01", "0.1")])
def test_query(spark, sf):
    rows = pd.read_parquet(f"{sf}/conversations.parquet").astype(object).itertuples(index=False)
    convs = plain_damage([(r.conv_id, r.turn, r.role, r.text) for r in rows])
    found = registry.queries()["op12_conversations"](spark, sf).collect()
    assert [tuple(r) for r in order(found)] == order(wanted(k, v, all_nodes) for k, v in convs.items())


def test_turns(spark):
    rows = [(1, 0, "user", "Hello."), (1, 2, "user", "Again."), (2, 0, "assistant", "")]
    frame = spark.createDataFrame([(*r, True) for r in rows], f"{ROWS}, there boolean")
    assert [tuple(r) for r in C.repaired_turns(frame).orderBy("conv_id", "position").collect()] == [(1, 0, "K", "user", "Hello."), (1, 1, "R", "assistant", "Again.")]
    assert C.repaired_turns(frame.where("false")).count() == C.repairs(frame.where("false")).count() == 0
    gone = C.repairs(frame.withColumn("there", frame.conv_id == 1)).where("conv_id = 2").first()
    assert tuple(gone) == (2, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
