"""Aggregation of experiment runs over seeds, skylines, acceptance gates and case selection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metric_long(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row a metric."""
    return runs.unpivot(keys, metrics, "metric", "value")


def seed_aggregate(long: DataFrame, keys: list[str], seed: str = "seed", digits: int = 6) -> DataFrame:
    """Mean and population deviation over seeds, and a map seed -> value; seeds of a group must be distinct, which ``n`` and ``seeds`` show."""
    found = long.groupBy(*keys, "metric").agg(
        F.count("*").alias("n"), F.countDistinct(seed).alias("seeds"), F.round(F.avg("value"), digits).alias("mean"), F.round(F.stddev_pop("value"), digits).alias("std"), F.sort_array(F.collect_list(F.struct(F.col(seed).alias("seed"), F.round("value", digits).alias("value")))).alias("by_seed")
    )
    return found.withColumn("by_seed", F.map_from_entries("by_seed"))


def metric_wide(long: DataFrame, keys: list[str], metrics: list[str], digits: int = 6) -> DataFrame:
    """``{metric}_mean`` and ``{metric}_std`` columns; the metrics are named, so no job finds them out."""
    wide = long.groupBy(*keys).pivot("metric", metrics).agg(F.round(F.avg("value"), digits).alias("mean"), F.round(F.stddev_pop("value"), digits).alias("std"))
    return wide


def pareto_front(rows: DataFrame, front: list[str], a: str, b: str) -> DataFrame:
    """Adds ``on_front``: no row of the same front is as small in both and smaller in one.

    By windows instead of a comparison of all pairs: in order of (a, b), a row
    is dominated iff some row of a strictly smaller ``a`` has a ``b`` as small,
    or one of the same ``a`` has a strictly smaller ``b``.
    """
    inside = Window.partitionBy(*front)
    smaller = F.min(b).over(inside.orderBy(a).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    least = rows.withColumns({"_own": F.min(b).over(Window.partitionBy(*front, a)), "_upto": smaller})
    earlier = F.lag("_m").over(inside.orderBy(a))
    cells = least.groupBy(*front, a).agg(F.min("_upto").alias("_m")).withColumn("_before", earlier).drop("_m")
    joined = least.join(cells, [*front, a])
    dominated = (F.col(b) > F.col("_own")) | F.coalesce(F.col("_before") <= F.col(b), F.lit(False))
    return joined.withColumn("on_front", ~dominated).drop("_own", "_upto", "_before")


def gates(aggregated: DataFrame, keys: list[str], strategy: str, better: str, base: str, metric: str, budget: str, tolerance: float = 1e-9) -> DataFrame:
    """Per key whether ``better`` has a smaller metric than ``base`` where their budgets agree: pass, fail or not_evaluable."""
    a = aggregated.where(F.col(strategy) == better).select(*keys, F.col(metric).alias("ours"), F.col(budget).alias("our_budget"))
    b = aggregated.where(F.col(strategy) == base).select(*keys, F.col(metric).alias("theirs"), F.col(budget).alias("their_budget"))
    same = F.abs(F.col("our_budget") - F.col("their_budget")) <= tolerance
    outcome = F.when(F.col("ours").isNull() | F.col("theirs").isNull() | ~same, "not_evaluable").when(F.col("ours") < F.col("theirs"), "pass").otherwise("fail")
    return a.join(b, keys, "full").select(*keys, outcome.alias("outcome"))


def completeness(expected: DataFrame, done: DataFrame, keys: list[str], failed: str) -> DataFrame:
    """Expected, completed, failed and missing runs; extra ones are counted too."""
    both = expected.withColumn("_e", F.lit(1)).join(done.withColumn("_d", F.lit(1)), keys, "full")
    ones = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    e, d = F.col("_e").isNotNull(), F.col("_d").isNotNull()
    bad = F.coalesce(F.col(failed), F.lit(False))
    return both.agg(ones(e).alias("expected"), ones(e & d & ~bad).alias("completed"), ones(e & d & bad).alias("failed"), ones(e & ~d).alias("missing"), ones(~e & d).alias("extra"))


def case_round_robin(rows: DataFrame, order: list[str], labels: str, cycle: list[str], most: int = 10) -> DataFrame:
    """At most ``most`` cases, taken by label in turn, each row once, in ``order``; ends when a full turn adds none.

    Only the first ``most`` candidates of each label can ever be taken, so the
    choice is made over at most that many rows a label.
    """
    each = rows.select(*order, F.col(labels).alias("_all"), F.explode(labels).alias("_label")).where(F.col("_label").isin(cycle))
    # A label loses at most `most` of its first rows to other labels.
    heads = each.withColumn("_i", F.row_number().over(Window.partitionBy("_label").orderBy(*order))).where(F.col("_i") <= 2 * most).drop("_i", "_all")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*order).schema.fields), "label string, place int"])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(batches) or [pd.DataFrame(columns=[*order, "_label"])]).sort_values(order)
        queues = {x: list(found[found["_label"] == x][order].itertuples(index=False, name=None)) for x in cycle}
        used: set[tuple] = set()
        taken: list[tuple] = []
        added = True
        while added and len(taken) < most:
            added = False
            for label in cycle:
                row = next((r for r in queues[label] if r not in used), None)
                if row is not None and len(taken) < most:
                    used.add(row)
                    taken.append((*row, label, len(taken)))
                    added = True
        yield pd.DataFrame(taken, columns=[*order, "label", "place"])

    return heads.coalesce(1).mapInPandas(choose, schema)
