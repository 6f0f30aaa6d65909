"""Scenario operators on small frames: nulls, drops, missing tracks and unequal lengths."""

from pyspark.sql import functions as F

from tracklume.operators import scenarios as S


def test_fan_out_of_a_null_budget_drops_all_actions(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, None), (3, 0.6)], "k long, b double")
    found = S.fan_out(rows, F.col("b")).groupBy("k").agg(F.sum(F.col("feasible").cast("int")).alias("n"), F.max("complete").alias("c"))
    assert {r["k"]: (r["n"], r["c"]) for r in found.collect()} == {1: (6, True), 2: (0, False), 3: (1, False)}


def test_edits_name_what_changed(spark):
    rows = spark.createDataFrame([({"a": 1.0, "b": 2.0},)], "state map<string,double>")
    found = S.edited(rows, "state", {"same": ("a", F.lit(1.0)), "moved": ("a", F.lit(3.0)), "gone": ("b", None)})
    assert {r["variant"]: (r["after"], r["changed"]) for r in found.collect()} == {"same": ({"a": 1.0, "b": 2.0}, []), "moved": ({"a": 3.0, "b": 2.0}, ["a"]), "gone": ({"a": 1.0}, ["b"])}


def test_missing_tracks_overlap(spark):
    objects, track = spark.createDataFrame([(1,), (2,), (3,)], "k long"), spark.createDataFrame([(1, 0.0), (2, 1.0), (2, None)], "k long, c double")
    assert {r["k"]: (r["missing"], r["overlap"]) for r in S.overlaps(objects, track, "k", F.col("c")).collect()} == {1: (False, True), 2: (False, False), 3: (True, True)}


def test_zip_tells_unequal_lengths(spark):
    left, right = spark.createDataFrame([("g", 1), ("g", 2)], "g string, a long"), spark.createDataFrame([("g", 9)], "g string, b long")
    found = S.zipped(left, right, "g", [F.col("a")], [F.col("b")]).orderBy("position").collect()
    assert [(r["a"], r["b"], r["matched"]) for r in found] == [(1, 9, True), (2, None, False)]
