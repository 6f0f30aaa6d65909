"""Ranking metrics.  Rows are first summed up by score, so that no window runs over the rows themselves.

An undefined metric is a null value with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklume.sources.shared_tables import SharedTables


def _by_score(rows: DataFrame, label: str, score: str) -> DataFrame:
    return rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count("*").cast("double").alias("n"))


def _running(scored: DataFrame, values: list[str], down: bool = False) -> DataFrame:
    """``scored`` (a row a score ``s``) with, for each value, ``before_<value>``: its sum over all lower scores, or all higher ones.

    The rows are written once, dealt into ranges of scores and written again:
    so the plan behind them runs once, and totals and rows see the same ranges.
    Sums run within ranges, and over the ranges' totals; no task sees all scores.
    """
    tables = SharedTables(scored.sparkSession, "ranking")
    held = tables.write(scored, "scored")
    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = tables.write(held.repartitionByRange(n, "s").withColumn("_range", F.spark_partition_id()), "ranged")
    tables.drop("scored")
    way = F.desc if down else F.asc
    outer = Window.orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    inner = Window.partitionBy("_range").orderBy(way("s")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_t_{v}").over(outer), F.lit(0.0)).alias(f"_o_{v}") for v in values))
    placed = ranged.join(F.broadcast(totals), "_range")
    return placed.select(*scored.columns, *((F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(inner), F.lit(0.0))).alias(f"before_{v}") for v in values))


def _named(df: DataFrame, name: str, value: Column, ok: Column, reason: str) -> DataFrame:
    return df.select(F.lit(name).alias("metric"), F.when(ok, F.round(value, 9)).alias("value"), F.when(~ok, F.lit(reason)).alias("reason"))


def auroc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Mann-Whitney with average ranks of ties; null if a class is missing."""
    ranked = _running(_by_score(rows, label, score), ["n"]).withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    value = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return _named(sums, "auroc", value, (F.col("p") > 0) & (F.col("q") > 0), "one class only")


def _curve(rows: DataFrame, label: str, score: str) -> DataFrame:
    curve = _running(_by_score(rows, label, score), ["pos", "n"], down=True)
    return curve.withColumn("precision", (F.col("before_pos") + F.col("pos")) / (F.col("before_n") + F.col("n")))


def average_precision(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Steps over distinct thresholds: gained recall times precision."""
    sums = _curve(rows, label, score).agg(F.sum(F.col("pos") * F.col("precision")).alias("a"), F.sum("pos").alias("p"))
    return _named(sums, "average_precision", F.col("a") / F.col("p"), F.col("p") > 0, "no positives")


def auprc_trapezoid(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Trapezoids under the precision-recall curve, which starts at (0, 1)."""
    before = F.when(F.col("before_n") > 0, F.col("before_pos") / F.col("before_n")).otherwise(1.0)
    sums = _curve(rows, label, score).withColumn("mean", (before + F.col("precision")) / 2).agg(F.sum(F.col("pos") * F.col("mean")).alias("a"), F.sum("pos").alias("p"))
    return _named(sums, "auprc_trapezoid", F.col("a") / F.col("p"), F.col("p") > 0, "no positives")


def average_rank(column: str, within: list[str] | None = None) -> Column:
    """Ranks from 1, ties at their mean."""
    order = Window.partitionBy(*(within or [])).orderBy(column)
    ties = Window.partitionBy(*(within or []), column)
    return F.rank().over(order).cast("double") + (F.count("*").over(ties) - 1).cast("double") / 2


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's correlation of average ranks; 0 where either is constant; null values are left out."""
    rows = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranked(column: str, name: str) -> DataFrame:
        counts = rows.groupBy(F.col(column).alias("s")).agg(F.count("*").cast("double").alias("n"))
        return _running(counts, ["n"]).select(F.col("s").alias(f"_{name}"), (F.col("before_n") + (F.col("n") + 1) / 2).alias(name))

    pairs = rows.select(F.col(a).alias("a"), F.col(b).alias("b"))
    ranks = pairs.join(ranked(a, "x"), F.col("a") == F.col("_x")).join(ranked(b, "y"), F.col("b") == F.col("_y")).select("x", "y")
    value = F.when((F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0), F.corr("x", "y")).otherwise(0.0)
    return ranks.agg(F.round(value, 9).alias("value")).select(F.lit("spearman").alias("metric"), "value")


def pairwise_ordering(rows: DataFrame, group: str, key: str, target: str, prediction: str, eligible: Column) -> DataFrame:
    """Within groups: credit 1 for a pair ordered as its targets are, 1/2 for tied predictions; pairs of equal targets are skipped.

    Pairs of a group come from counts of (target, prediction), not from rows:
    a group is quadratic only in its distinct values.
    """
    usable = rows.where(eligible)
    sizes = usable.groupBy(group).count()
    cells = usable.groupBy(group, F.col(target).alias("t"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    other = cells.select(group, F.col("t").alias("u"), F.col("p").alias("q"), F.col("n").alias("m"))
    pairs = cells.join(other, group).where("t > u")
    credit = F.when(F.col("p") > F.col("q"), 1.0).when(F.col("p") == F.col("q"), 0.5).otherwise(0.0)
    won = pairs.agg(F.sum(F.col("n") * F.col("m") * credit).alias("won"), F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("pairs"))
    groups = sizes.agg(F.coalesce(F.sum(F.when(F.col("count") == 1, 1).otherwise(0)), F.lit(0)).alias("singletons"), F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0)).cast("long").alias("all_pairs"))
    dropped = rows.where(~eligible).agg(F.count("*").alias("ineligible"))
    found = won.crossJoin(F.broadcast(groups)).crossJoin(F.broadcast(dropped))  # one row each
    return found.select(F.round(F.when(F.col("pairs") > 0, F.col("won") / F.col("pairs")), 9).alias("accuracy"), "pairs", (F.col("all_pairs") - F.col("pairs")).alias("target_ties"), "singletons", "ineligible")


def best_by_group(rows: DataFrame, group: str, action: str, prediction: str, target: str) -> DataFrame:
    """For each group the action of the largest prediction (ties: the smallest action), its regret, and whether the best is among the first two."""
    order = Window.partitionBy(group).orderBy(F.desc(prediction), F.asc(action))
    ranked = rows.withColumns({"_r": F.row_number().over(order), "_best": F.max(target).over(Window.partitionBy(group))})
    return ranked.groupBy(group).agg(
        F.max(F.when(F.col("_r") == 1, F.col(action))).alias("selected"),
        F.max(F.when(F.col("_r") == 1, F.col("_best") - F.col(target))).alias("regret"),
        F.max(F.when((F.col("_r") <= 2) & (F.col(target) == F.col("_best")), 1).otherwise(0)).alias("top2"),
    )
