"""Joins and set operations that check what they join: sidecars, revaluations, window joins, unions and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_join(decisions: DataFrame, observations: DataFrame, key: str, t: str, reach: float) -> DataFrame:
    """Every observation of a decision's ``key`` at a time in [t - reach, t], with the decision; ``seen`` is its time.

    Time is cut into cells of ``reach``: a decision meets its own cell and the
    one before by an equi-join, so no key's rows are all compared.
    """
    cell = F.floor(F.col(t) / reach)
    asked = decisions.withColumn("_cell", F.explode(F.array(cell - 1, cell)))
    held = observations.withColumn("_cell", cell).withColumnRenamed(t, "seen")
    return asked.join(held, [key, "_cell"]).where((F.col("seen") >= F.col(t) - reach) & (F.col("seen") <= F.col(t))).drop("_cell")


def sidecar_audit(facts: DataFrame, sidecar: DataFrame, keys: list[str], shard: str) -> DataFrame:
    """A strict 1:1 join of facts and a sidecar, by shard: matched keys, facts without a row, rows without a fact, and keys that come twice on a side."""
    count = lambda rows, name: rows.groupBy(*keys).agg(F.count("*").alias(name))
    both = count(facts, "_f").join(count(sidecar, "_s"), keys, "full")
    f, s = F.coalesce("_f", F.lit(0)), F.coalesce("_s", F.lit(0))
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return both.groupBy(shard).agg(flag((f == 1) & (s == 1)).alias("matched"), flag(s == 0).alias("missing"), flag(f == 0).alias("orphans"), flag((f > 1) | (s > 1)).alias("repeated"))


def keyed_join(left: DataFrame, right: DataFrame, key: str, agree: list[str]) -> DataFrame:
    """An inner join on ``key`` with ``disagree``: the secondary keys that differ, in the order given."""
    other = right.select(key, *(F.col(c).alias(f"_{c}") for c in agree), *(c for c in right.columns if c not in {key, *agree}))
    wrong = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in agree)), lambda x: x.isNotNull())
    return left.join(other, key).withColumn("disagree", wrong).drop(*(f"_{c}" for c in agree))


def union_checked(parts: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """UNION ALL of named parts of equal columns with ``part`` and ``copies``: in how many rows of all parts the key stands."""
    rows = None
    for name, part in parts:
        named = part.withColumn("part", F.lit(name))
        rows = named if rows is None else rows.unionByName(named)
    copies = rows.groupBy(key).agg(F.count("*").alias("copies"))
    return rows.join(copies, key)


def unpublished(rows: DataFrame, release: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in a release."""
    return rows.join(release.select(key).distinct(), key, "left_anti")


def first_least(rows: DataFrame, group: str, value: str, order: str, carried: list[str]) -> DataFrame:
    """Of each group the row of the least value, the earliest of equal ones."""
    found = rows.groupBy(group).agg(F.min(F.struct(value, order, *carried)).alias("_m"))
    return found.select(group, *(F.col(f"_m.{c}").alias(c) for c in (value, order, *carried)))


def binary_scores(label: Column, score: Column, threshold: float, eps: float = 1e-7) -> list[Column]:
    """Brier, cross-entropy (clipped), IoU, accuracy, precision and recall; nothing to find and nothing found counts as 1, and a ratio over nothing else as 0."""
    y, said = label.cast("double"), score >= threshold
    p = F.greatest(F.least(score, F.lit(1 - eps)), F.lit(eps))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    tp, fp, fn = count(said & (label == 1)), count(said & (label == 0)), count(~said & (label == 1))
    ratio = lambda over: F.round(F.when(tp + fp + fn == 0, 1.0).when(over == 0, 0.0).otherwise(tp / over), 9)
    return [
        F.round(F.avg((score - y) ** 2), 9).alias("brier"),
        F.round(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))), 9).alias("bce"),
        ratio(tp + fp + fn).alias("iou"),
        F.round(F.avg((said.cast("int") == label).cast("double")), 9).alias("accuracy"),
        ratio(tp + fp).alias("precision"),
        ratio(tp + fn).alias("recall"),
    ]


def pose_at(fraction: Column, x: tuple[Column, Column], y: tuple[Column, Column], yaw: tuple[Column, Column]) -> list[Column]:
    """x, y and yaw between two poses: positions linearly, the yaw over the shorter arc, in [-pi, pi); null outside [0, 1]."""
    inside = (fraction >= 0) & (fraction <= 1)
    turn = 2 * F.pi()
    wrap = lambda a: a + F.pi() - turn * F.floor((a + F.pi()) / turn) - F.pi()
    between = lambda a, b: a + fraction * (b - a)
    arc = wrap(yaw[0] + fraction * wrap(yaw[1] - yaw[0]))
    return [F.when(inside, v).alias(n) for v, n in ((between(*x), "x"), (between(*y), "y"), (arc, "yaw"))]


def pointer_token(name: Column) -> Column:
    """A key as a token of a JSON pointer."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
