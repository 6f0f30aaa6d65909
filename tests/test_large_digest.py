"""The digest of a table of more rows than fit one level of small leaves, by hashlib."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tracklume.functions import digests as D


def test_one_level_at_any_size(spark):
    rows = spark.range(300_000).selectExpr("id", "id % 7 as k").unionByName(spark.range(5).selectExpr("id", "id % 7 as k"))
    counts = Counter(hashlib.sha256(f"{i}|{i % 7}".encode()).hexdigest() for i in [*range(300_000), *range(5)])
    leaves = defaultdict(list)
    for h, c in counts.items():
        leaves[h[:2]].append(f"{h}:{c}")
    told = ",".join(hashlib.sha256(",".join(sorted(leaves[b])).encode()).hexdigest() for b in sorted(leaves))
    assert tuple(D.table_digest(rows, [F.col("id"), F.col("k")]).first()) == (hashlib.sha256(told.encode()).hexdigest(), 300_005)
