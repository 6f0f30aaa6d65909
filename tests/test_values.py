"""Operators against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tracklume.functions import geometry as E
from tracklume.operators import calibration as C
from tracklume.operators import experiments as X
from tracklume.operators import quality as Q
from tracklume.operators import ranking as R
from tracklume.operators import splits as S
from tracklume.operators import tracks as K
from tracklume.operators.segments import segments


def one(df):
    return df.first()


def test_ranking(spark):
    """Four rows, a tie over the classes: of four pairs two are right and two halved are one."""
    rows = spark.createDataFrame([(1, 0.6), (0, 0.4), (1, 0.4), (0, 0.1)], "y int, s double")
    assert one(R.auroc(rows, "y", "s")).value == pytest.approx(3.5 / 4)
    assert one(R.average_precision(rows, "y", "s")).value == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert one(R.auprc_trapezoid(rows, "y", "s")).value == pytest.approx(0.5 * 1 + 0.5 * (1 + 2 / 3) / 2)
    single = spark.createDataFrame([(0, 0.3), (0, 0.2)], "y int, s double")
    found = one(R.auroc(single, "y", "s"))
    assert found.value is None and found.reason == "one class only"


def test_probability(spark):
    rows = spark.createDataFrame([(1, 0.7), (0, 0.4)], "y int, p double")
    found = one(C.brier_nll(rows, "y", "p"))
    assert found.brier == pytest.approx((0.09 + 0.16) / 2) and found.nll == pytest.approx(-(math.log(0.7) + math.log(0.6)) / 2)
    assert one(C.ece(rows, "y", "p", 2)).ece == pytest.approx((0.3 + 0.4) / 2)
    edge = spark.createDataFrame([(0, 0.0), (1, 1.0), (1, 1.0)], "y int, p double")
    assert one(C.ece(edge, "y", "p")).ece == 0.0
    safe = spark.createDataFrame([(1, 0.1), (1, 0.4), (1, 0.9), (0, 0.2)], "y int, p double")
    assert one(C.false_safe_rate(safe, "y", "p", 0.3)).rate == pytest.approx(1 / 3)
    cover = spark.createDataFrame([(0.5, 0.9), (0.6, 0.2), (0.1, 0.1)], "y double, u double")
    found = one(cover.agg(*C.coverage(cover, "y", "u")))
    assert (found.coverage, found.excess, found.mean_upper) == (pytest.approx(2 / 3), pytest.approx(0.4 / 3), pytest.approx(0.4))


def test_conformal_rank(spark):
    rows = spark.createDataFrame([(float(i), 0.0, "a" if i < 25 else "b") for i in range(1, 31)], "y double, q double, g string")
    found = {(r.dimension, r.key): r for r in C.conformal(rows, "y", "q", ["g"], 0.1).collect()}
    assert found["all", "all"].correction == 28.0  # ceil(31 * 0.9)
    assert found["g", "a"].correction == 23.0 and found["g", "a"].reason is None
    assert found["g", "b"].correction == 28.0 and found["g", "b"].reason == "small_group"


def test_clearances(spark):
    row = spark.range(1)
    lit = F.lit
    cases = [(E.circle_circle(lit(1.0), lit(1.0), lit(0.25), lit(1.0), lit(1.0 + d), lit(0.5)), w) for d, w in ((2.0, 1.25), (0.75, 0.0), (0.5, -0.25))]
    cases.append((E.circle_rectangle(lit(-4.0), lit(5.0), lit(1.0), lit(0.0), lit(0.0), lit(math.pi / 2), lit(4.0), lit(2.0)), math.hypot(3, 3) - 1))
    cases.append((E.circle_rectangle(lit(0.75), lit(0.0), lit(0.5), lit(0.0), lit(0.0), lit(math.pi / 2), lit(4.0), lit(2.0)), -0.75))
    found = one(row.select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))))
    assert list(found) == pytest.approx([w for _, w in cases], abs=1e-9)


def test_segments_and_resampling(spark):
    rows = spark.createDataFrame([(1, t, 2.0 * t) for t in (0.0, 0.1, 0.35, 2.0, 2.2)], "o int, t double, x double")
    cut = segments(rows, "o", "t", 0.5)
    assert [r.segment_id for r in cut.orderBy("t").collect()] == [0, 0, 0, 1, 1]
    found = K.resample(cut, ["o", "segment_id"], "t", ["x"], 0.1).orderBy("tick").collect()
    assert [r.tick for r in found] == [0, 1, 2, 3, 20, 21, 22]
    assert [r.x for r in found] == pytest.approx([0, 0.2, 0.4, 0.6, 4.0, 4.2, 4.4])
    assert segments(rows.limit(0), "o", "t", 0.5).count() == 0


def test_exact_tolerance(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 1.0)], "a int, t double")
    b = spark.createDataFrame([(1, 0.05), (2, 1.2), (3, -0.1)], "b int, t double")
    assert sorted((r.a, r.b) for r in K.exact_tick_join(a, b, "t", 0.1).collect()) == [(1, 1), (1, 3)]


def test_quotas_and_components(spark):
    ten = spark.range(10).withColumnRenamed("id", "g")
    # The split's shares are 0.7, 0.1, 0.1 and 0.1.
    assert {r.split: r.quota for r in S.quotas(ten).collect()} == {"train": 7, "calibration": 1, "val": 1, "test": 1}
    found = S.split_by_hash(ten, "g", "3").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in found} == {"train": 7, "calibration": 1, "val": 1, "test": 1}
    again = S.split_by_hash(ten.repartition(3), "g", "3").orderBy("g").collect()
    assert again == S.split_by_hash(ten, "g", "3").orderBy("g").collect()
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("f", "f")] + [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)], "a string, b string")
    parts = {r.node: r.component for r in S.components(edges, "a", "b").collect()}
    assert parts["c"] == "a" and parts["e"] == "d" and parts["f"] == "f" and parts["n20"] == "n00"


def test_whole_tables(spark, tmp_path):
    """Components of all rows against union-find, and an overlap with a split that is neither 0 nor 1."""
    import random

    from tracklume.plans import catalogue

    own = random.Random(4)
    rows = [(own.randrange(25), own.randrange(60), float(own.randint(1, 50)), own.randint(0, 10) / 100) for _ in range(45)] + [(None, 3, 1.0, 0.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for s, p, *_ in rows[:-1]:
        a, b = sorted((top(f"s{s}"), top(f"p{p}")))
        root[b] = a
    found = {r.node: r.component for r in catalogue.queries()["split_components"](spark, str(tmp_path)).collect()}
    assert found == {x: top(x) for x in root} and len(set(found.values())) > 1
    spark.createDataFrame([(10, "same", "en"), (11, "one", "de"), (17, "same", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.field: r.overlap for r in catalogue.queries()["isolation_overlap"](spark, str(tmp_path)).collect()}
    assert found == {"doc_id": 0, "text_digest": 1, "lang": 1}


def test_partition_plan(spark):
    rows = spark.createDataFrame([(f"s{i:02}",) for i in range(11)], "id string")
    found = S.partition_plan(rows, ["id"], 3, 2).orderBy("id").collect()
    assert [r["rank"] for r in found] == [0] * 3 + [1] * 4 + [2] * 4
    assert max(r.step for r in found) == 1 and {(r["rank"], r.step) for r in found} == {(a, b) for a in range(3) for b in range(2)}


def test_case_round_robin(spark):
    rows = spark.createDataFrame([(i, ["a"] if i < 8 else ["a", "b"]) for i in range(10)], "k int, labels array<string>")
    found = X.case_round_robin(rows, ["k"], "labels", ["a", "b"], 5).orderBy("place").collect()
    assert [(r.k, r.label) for r in found] == [(0, "a"), (8, "b"), (1, "a"), (9, "b"), (2, "a")]


def test_contracts(spark):
    rows = spark.createDataFrame([(1, None), (2, 5.0)], "k int, v double")
    assert [tuple(r) for r in Q.violations(rows, "k", [("positive", F.col("v") > 0)]).collect()] == [(1, "positive")]
    assert Q.forbidden_fields(spark.createDataFrame([], "a int, b struct<Oracle_x: int>, c array<struct<future: int>>").schema) == ["b.Oracle_x", "c.future"]
