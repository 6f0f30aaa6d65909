"""Probability scores, coverage, and split-conformal calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklume.operators.selection import order_statistics

#: Groups under this size take the global correction.
MIN_GROUP = 20


def brier_nll(rows: DataFrame, label: str, p: str, eps: float = 1e-7) -> DataFrame:
    """Mean squared error and log loss of probabilities clipped to [eps, 1 - eps]."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return rows.agg(F.round(F.avg((F.col(p) - F.col(label)) ** 2), 9).alias("brier"), F.round(-F.avg(F.when(F.col(label) == 1, F.log(q)).otherwise(F.log(1 - q))), 9).alias("nll"))


def ece_bins(rows: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the top one closed; empty ones are there with nulls."""
    place = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    found = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(found), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"))


def ece(rows: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    place = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    found = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(p) - F.avg(F.col(label).cast("double"))).alias("gap"))
    return found.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 9).alias("ece"))


def false_safe_rate(rows: DataFrame, label: str, p: str, threshold: float) -> DataFrame:
    """Positives predicted strictly under the threshold; null without positives."""
    hit = F.sum(F.when((F.col(label) == 1) & (F.col(p) < threshold), 1).otherwise(0))
    return rows.agg(F.sum(F.col(label).cast("long")).alias("positives"), hit.alias("false_safe")).select("positives", "false_safe", F.round(F.when(F.col("positives") > 0, F.col("false_safe") / F.col("positives")), 9).alias("rate"))


def coverage(rows: DataFrame, y: str, upper: str) -> list[Column]:
    return [
        F.round(F.avg(F.when(F.col(y) <= F.col(upper), 1.0).otherwise(0.0)), 9).alias("coverage"),
        F.round(F.avg(F.greatest(F.lit(0.0), F.col(upper) - F.col(y))), 9).alias("excess"),
        F.round(F.avg(upper), 9).alias("mean_upper"),
    ]


def order_statistic(residuals: DataFrame, group: list[str], residual: str, alpha: float) -> DataFrame:
    """The k-th smallest residual of each group, k = min(n, ceil((n + 1)(1 - alpha))), by rounds of range counts."""
    rank = lambda n: F.least(n, F.ceil((n + 1) * (1 - F.lit(alpha))))
    return order_statistics(residuals, group, residual, {"correction": rank}).withColumn("k", rank(F.col("n")).cast("long"))


def conformal(rows: DataFrame, y: str, q: str, dimensions: list[str], alpha: float, least: int = MIN_GROUP) -> DataFrame:
    """Global and per-dimension corrections: method, dimension, key, correction, n, k, reason.  Small groups copy the global one, and say so."""
    residuals = rows.withColumn("_r", F.greatest(F.lit(0.0), F.col(y) - F.col(q)))
    pairs = [F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("key")), *(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("missing")).alias("key")) for d in dimensions)]
    long = residuals.select("_r", F.explode(F.array(*pairs)).alias("g")).select("_r", "g.dimension", "g.key")
    found = order_statistic(long, ["dimension", "key"], "_r", alpha)
    base = found.where("dimension = 'all'").select(F.col("correction").alias("_c"))
    small = (F.col("n") < least) & (F.col("dimension") != "all")
    return found.join(F.broadcast(base), how="cross").select("dimension", "key", F.when(small, F.col("_c")).otherwise(F.col("correction")).alias("correction"), "n", "k", F.when(small, "small_group").alias("reason"))


def apply_conformal(rows: DataFrame, corrections: DataFrame, q: str, dimension: str) -> DataFrame:
    """clip(q + c, 0, 1) by the row's group; an unseen group takes the global correction.  Corrections are a row a group."""
    own = corrections.where(F.col("dimension") == dimension).select(F.col("key").alias("_key"), F.col("correction").alias("_own"))
    base = corrections.where("dimension = 'all'").select(F.col("correction").alias("_all"))
    keyed = rows.withColumn("_key", F.coalesce(F.col(dimension).cast("string"), F.lit("missing")))
    joined = keyed.join(own, "_key", "left").join(F.broadcast(base), how="cross")
    clipped = F.least(F.greatest(F.col(q) + F.coalesce("_own", "_all"), F.lit(0.0)), F.lit(1.0))
    return joined.withColumn("calibrated", clipped).drop("_key", "_own", "_all")


def bin_label(value: Column, edges: list[float]) -> Column:
    """``[a,b)`` labels, the last bin closed, ``out_of_range`` beyond and ``missing`` for null; edges in %g."""
    out = F.when(value.isNull(), "missing")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        last = i == len(edges) - 2
        out = out.when((value >= a) & ((value <= b) if last else (value < b)), f"[{a:g},{b:g}{']' if last else ')'}")
    return out.otherwise("out_of_range")
