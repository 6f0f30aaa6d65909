"""Order statistics and inversions by rounds, against sorting and all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklume.operators import inversions as I
from tracklume.operators import selection as S


def values(n=3000):
    own = random.Random(9)
    law = {"even": lambda: own.random(), "ties": lambda: float(own.randrange(4)), "steep": lambda: 10 ** own.uniform(-200, 200), "hot": lambda: 0.5 if own.random() < 0.7 else own.random(), None: lambda: -own.expovariate(1), "one": lambda: 7.0}
    return [(g, f()) for g, f in law.items() for _ in range(n)] + [("few", 3.0), ("few", 1.0), ("few", None), ("none", None)]


@pytest.mark.parametrize("left", [5, 300, 1_000_000])
def test_order_statistics(spark, monkeypatch, left):
    monkeypatch.setattr(S, "LEFT", left)
    rows = values()
    frame = spark.createDataFrame([(g, 1, v) for g, v in rows], "g string, h int, v double")
    found = {r.g: r for r in S.order_statistics(frame, ["g", "h"], "v", {"first": lambda n: F.lit(1), "some": lambda n: F.floor(n * 0.37) + 1, "last": lambda n: n, "beyond": lambda n: n + 1}).collect()}
    assert set(found) == {"even", "ties", "steep", "hot", None, "one", "few"}
    for g, r in found.items():
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert (r.n, r.first, r.some, r.last, r.beyond) == (len(own), own[0], own[int(len(own) * 0.37)], own[-1], None)
    cuts = {r.g: r for r in S.quantiles(frame, ["g"], "v", {"p05": 0.05, "p90": 0.9}).collect()}
    for g, r in cuts.items():
        assert np.allclose((r.p05, r.p90), np.quantile([v for k, v in rows if k == g and v is not None], [0.05, 0.9]))


def test_no_values(spark):
    frame = spark.createDataFrame([], "g string, v double")
    assert S.quantiles(frame, ["g"], "v", {"p50": 0.5}).count() == 0 and S.order_statistics(frame, [], "v", {"a": lambda n: n}).count() == 0


def all_pairs(rows):
    known = [(x, y) for x, y in rows if x is not None and y is not None]
    return sum((x < u and y > v) or (u < x and v > y) for i, (x, y) in enumerate(known) for u, v in known[i + 1 :])


def test_inversions_in_a_task():
    own = random.Random(2)
    for _ in range(60):
        n = own.randint(1, 40)
        x, y, w = ([own.randrange(k) for _ in range(n)] for k in (own.choice([2, 5, 50]), own.choice([2, 5, 50]), 4))
        wanted = sum(w[i] * w[j] for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j])
        assert I.weighted_inversions(np.array(x), np.array(y), np.array(w)) == wanted


@pytest.mark.parametrize("left", [20, 50_000])
def test_inversions(spark, monkeypatch, left):
    monkeypatch.setattr(I, "LEFT", left)
    own = random.Random(left)
    made = {"mixed": lambda: (own.random(), own.random()), "ties": lambda: (own.randrange(6), own.randrange(6)), "hot": lambda: (0 if own.random() < 0.5 else own.random(), own.choice([0, 1, own.random()])), None: lambda: (own.randrange(300), own.choice([None, own.random()])), "flat": lambda: (1, own.random())}
    rows = [(g, *map(lambda v: None if v is None else float(v), f())) for g, f in made.items() for _ in range(400)] + [("single", 1.0, 1.0)]
    found = {r.g: r.inversions for r in I.inversions(spark.createDataFrame(rows, "g string, a double, b double"), "g", "a", "b").collect()}
    assert found == {g: all_pairs([(a, b) for k, a, b in rows if k == g]) for g in {r[0] for r in rows}}


def test_kendall(spark):
    rows = [("g", 1, 1), ("g", 2, 3), ("g", 3, 2), ("g", 3, 3), ("g", 3, 3), ("g", None, 4), ("flat", 1, 1), ("flat", 1, 2)]
    found = {r.g: tuple(r)[1:] for r in I.kendall(spark.createDataFrame(rows, "g string, a int, b int"), "g", "a", "b").collect()}
    # All ten pairs, one by one.
    pairs = [(x, y) for i, x in enumerate(rows[:5]) for y in rows[i + 1 : 5]]
    sign = lambda v: (v > 0) - (v < 0)
    kinds = [(sign(x[1] - y[1]), sign(x[2] - y[2])) for x, y in pairs]
    c, d = sum(p * q > 0 for p, q in kinds), sum(p * q < 0 for p, q in kinds)
    ta, tb = sum(p == 0 and q != 0 for p, q in kinds), sum(p != 0 and q == 0 for p, q in kinds)
    assert found["g"] == (c, d, ta, tb, round((c - d) / ((c + d + ta) * (c + d + tb)) ** 0.5, 9))
    assert found["flat"] == (0, 0, 1, 0, 0.0)
