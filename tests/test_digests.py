"""Digests against hashlib, trees of digests in any order and depth, and nested JSON against a plain walk."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tracklume.functions import digests as D
from tracklume.operators import nested as J


def test_blake2b(spark):
    rows = [(1, "a", None), (2, "", "é|x"), (None, "long " * 500, "z")]
    k, a, b = (F.col(c) for c in "kab")
    found = spark.createDataFrame(rows, "k long, a string, b string").select(D.stable_digest(k, a, b).alias("d"), D.derive_seed(7, k, a).alias("s"), D.sample_id(F.lit("train"), k, b).alias("i"), D.blake2b(b).alias("n")).collect()
    plain = lambda *parts: "|".join("" if p is None else str(p) for p in parts).encode()
    for (x, y, z), r in zip(rows, found, strict=True):
        assert r.d == hashlib.blake2b(plain(x, y, z), digest_size=16).hexdigest()
        assert r.s == int.from_bytes(hashlib.blake2b(plain("seed=7", x, y), digest_size=8).digest(), "big") % 2**32
        assert r.i == "train-" + hashlib.blake2b(plain("train", x, z), digest_size=12).hexdigest()
        assert r.n == (None if z is None else hashlib.blake2b(z.encode(), digest_size=16).hexdigest())


@pytest.mark.parametrize("leaf", [2, 1024])
def test_table_digest(spark, monkeypatch, leaf):
    """The same for any order and partitions, another for any change; frequent rows are one entry."""
    monkeypatch.setattr(D, "LEAF_ROWS", leaf)
    rows = [(i, f"n{i}") for i in range(700)] + [(-1, "hot")] * 300
    of = lambda r, n=3: spark.createDataFrame(r, "k long, v string").repartition(n)
    digest = lambda r, n=3: tuple(D.table_digest(of(r, n), [F.col("k"), F.col("v")]).first())
    first = digest(rows)
    assert first == digest(random.Random(1).sample(rows, len(rows)), 7) and first[1] == 1000
    assert len({first, digest(rows[:-1]), digest([*rows[:-1], (0, "n0")]), digest([(0, "m0"), *rows[1:]])}) == 4
    assert tuple(D.table_digest(of(rows).where("false"), [F.col("k")]).first()) == (hashlib.sha256(b"").hexdigest(), 0)


def walk(value, path=()):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, (*path, k.replace("\\", "\\\\").replace(".", "\\.")))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, (*path, str(i)))
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        yield ".".join(path), float(value)


def made(own, depth=0):
    kind = own.randrange(8 if depth < 5 else 4)
    if kind > 3:
        return {own.choice(["a", "b", "c.d", "e\\f", "ü", "0"]): made(own, depth + 1) for _ in range(own.randint(0, 3))} if kind > 5 else [made(own, depth + 1) for _ in range(own.randint(0, 3))]
    return own.choice([1, -2.5, 1e300, 12345678901, 0.1, True, None, "7", "x"])


def test_flattened(spark):
    own = random.Random(4)
    values = [made(own) for _ in range(120)] + [{"a": [[[[[[[{"b": 3}]]]]]]]}, 5, [], {}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, "{broken"), (902, "")]
    found = J.flattened(spark.createDataFrame(rows, "path long, t string"), ["path"], "t")
    assert found.columns == ["path", "path", "value"]
    assert sorted(map(tuple, found.collect())) == sorted((i, p, x) for i, v in enumerate(values) for p, x in walk(v))
    assert J.flattened(spark.createDataFrame([], "k long, t string"), ["k"], "t").count() == 0


def test_too_deep(spark, monkeypatch):
    monkeypatch.setattr(J, "DEPTH", 3)
    with pytest.raises(ValueError, match="levels deep"):
        J.flattened(spark.createDataFrame([(1, "[[[[[1]]]]]")], "k long, t string"), ["k"], "t")
