"""Clearances in steps of columns are those of one expression; copies of poses take those of theirs."""

import random

from pyspark.sql import functions as F

from made_tables import EVENTS, event, written
from oracle import same
from tracklume.functions.footprints import Shape, clearance, with_clearance
from tracklume.plans import contact_queries as Q


def test_steps(spark):
    own = random.Random(8)
    rows = [tuple(own.choice([0.0, 1.0, own.uniform(-3, 3)]) for _ in range(6)) for _ in range(80)]
    a, b = Shape.named("a", 2.0, 1.0, 0.1), Shape.named("b", 1.2, 0.8, 0.2)
    frame = spark.createDataFrame(rows, "ax double, ay double, ayaw double, bx double, by double, byaw double")
    found = with_clearance(frame.withColumn("c", clearance(a, b)), a, b, "d")
    assert found.columns == [*frame.columns, "c", "d"] and found.where(F.col("c") != F.col("d")).count() == 0


def test_copies_of_poses(spark, tmp_path):
    own = random.Random(2)
    rows = [event(i, own.choice([0.5, 3.2]), own.randrange(20), own.choice(["purchase", "view"]), own.choice([5.0, 9.5, 20.0, None])) for i in range(80)]
    folder, db = written(spark, tmp_path, events=(rows + [(r[0] + 700, *r[1:]) for r in rows[:30]], EVENTS))
    same(Q.near_rectangles, Q.ORACLE["near_rectangles"], spark, folder, db)
