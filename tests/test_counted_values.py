"""Order statistics of rows that stand for many."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracklume.operators import selection as S


def test_rows_that_stand_for_many(spark, monkeypatch):
    """Equal values are one row from the start: as many rows as there are different values are left, whatever the counts."""
    monkeypatch.setattr(S, "LEFT", 3)
    own = random.Random(5)
    rows = [(own.choice("ab"), round(own.random(), 2), own.randrange(1, 500)) for _ in range(300)]
    found = {r.g: r for r in S.quantiles(spark.createDataFrame(rows, "g string, v double, c long"), ["g"], "v", {"p10": 0.1, "p50": 0.5}, F.col("c")).collect()}
    for g, r in found.items():
        all_ = [v for k, v, c in rows if k == g for _ in range(c)]
        assert r.n == len(all_) and np.allclose((r.p10, r.p50), np.quantile(all_, [0.1, 0.5]))
