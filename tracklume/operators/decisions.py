"""Decision costs: rejection, verification, and the choice of a reject cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklume.operators.selection import quantiles
from tracklume.sources.shared_tables import SharedTables

#: The quantiles that a report gives.
QUANTILES = {"q0": 0.0, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q100": 1.0}


def reject_cost_rows(rows: DataFrame, candidates: list[float]) -> DataFrame:
    """``rows`` (execute, policy, cost) per candidate reject cost r: before = min(execute, r), after = min(policy or r, r) + cost, value.

    A null policy loss is a rejection.  Candidates are a stated short list, added as an array: no join.
    """
    each = rows.withColumn("reject_cost", F.explode(F.array(*(F.lit(float(c)) for c in candidates))))
    before = F.least("execute", "reject_cost")
    after = F.least(F.coalesce("policy", "reject_cost"), F.col("reject_cost")) + F.col("cost")
    return each.withColumns({"before": before, "after": after}).withColumn("value", F.col("before") - F.col("after"))


def reject_cost_report(valued: DataFrame, group: str, action: str, groups: int = 2, low: float = 0.10, high: float = 0.70, mixed: int = 2) -> DataFrame:
    """Per reject cost: rows, positives, their share, actions with both signs, seven quantiles of the value, and whether all checks pass."""
    reduces = F.when(F.col("value") > 0, F.col("before") - (F.col("after") - F.col("cost")) > F.col("cost"))
    cells = SharedTables(valued.sparkSession, "rejects").write(valued.groupBy("reject_cost", action, "value").agg(F.count("*").alias("c"), F.min(reduces).alias("reduces")), "cells")
    positive = F.when(F.col("value") > 0, F.col("c")).otherwise(0)
    by_action = cells.groupBy("reject_cost", action).agg(F.sum(positive).alias("p"), F.sum("c").alias("n"), F.min("reduces").alias("reduces"))
    actions = by_action.groupBy("reject_cost").agg(F.sum("n").alias("n"), F.sum("p").alias("positives"), F.sum(F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), 1).otherwise(0)).alias("mixed_actions"), F.min("reduces").alias("reduces"))
    counted = valued.select("reject_cost", group).distinct().groupBy("reject_cost").agg(F.count(group).alias("groups"))
    share = F.col("positives") / F.col("n")
    passes = (F.col("groups") >= groups) & (F.col("positives") > 0) & (F.col("positives") < F.col("n")) & share.between(low, high) & (F.col("mixed_actions") >= mixed) & F.coalesce("reduces", F.lit(False))
    cuts = quantiles(cells, ["reject_cost"], "value", QUANTILES, F.col("c")).drop("n")
    return actions.join(counted, "reject_cost").join(cuts, "reject_cost").select("reject_cost", "n", "groups", "positives", F.round(share, 9).alias("share"), "mixed_actions", *(F.round(q, 9).alias(q) for q in QUANTILES), passes.alias("passes"))


def decide(strategy: Column, execute: Column, reject: Column, best_value: Column, margin: float) -> Column:
    """``verify`` where the strategy lets it and, unless always, its value beats the margin strictly; else the cheaper of execute and reject, execute on a tie."""
    plain = F.when(execute <= reject, "execute").otherwise("reject")
    return F.when((strategy == "always") & best_value.isNotNull(), "verify").when((strategy == "value") & (best_value > margin), "verify").otherwise(plain)


def policy_value(policies: DataFrame, posterior: DataFrame, world: str, hypothesis: str, policy: str, loss: str, weight: str, reject: float) -> DataFrame:
    """For each observed world the policy of least expected loss under its posterior (ties: the smallest policy), clipped by the reject cost."""
    expected = posterior.join(policies, hypothesis).groupBy(world, policy).agg(F.sum(F.col(weight) * F.col(loss)).alias("expected"))
    best = expected.groupBy(world).agg(F.min(F.struct("expected", policy)).alias("b"))
    return best.select(world, F.col(f"b.{policy}").alias(policy), F.least("b.expected", F.lit(reject)).alias("loss"), (F.col("b.expected") >= reject).alias("rejects"))


def strategies(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "strategy string")


def first_success(attempts: DataFrame, key: str, order: str, accepted: Column, most: int = 32) -> DataFrame:
    """The first accepted of at most ``most`` ordered attempts of each key, and how many failed before it."""
    ranked = attempts.withColumns({"_i": F.row_number().over(Window.partitionBy(key).orderBy(order)), "_ok": accepted}).where(F.col("_i") <= most)
    return ranked.groupBy(key).agg(F.min(F.when(F.col("_ok"), F.struct("_i", order))).alias("hit"), F.count("*").alias("tried")).select(key, F.col(f"hit.{order}").alias("accepted"), F.coalesce(F.col("hit._i") - 1, F.col("tried")).cast("long").alias("failures"))
