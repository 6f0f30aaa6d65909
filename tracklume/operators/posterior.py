"""Observation posteriors over small banks of hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zscores(rows: DataFrame, key: list[str], feature: str, value: str, eps: float = 1e-12) -> DataFrame:
    """Long (key, feature, value) less the feature's mean over its population deviation; scales up to eps count as 1."""
    found = rows.groupBy(feature).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    scale = F.when(F.col("_s") > eps, F.col("_s")).otherwise(1.0)
    return rows.join(F.broadcast(found), feature).select(*key, feature, ((F.col(value) - F.col("_m")) / scale).alias("z"))  # a row a feature


def soft_posterior(vectors: DataFrame, bank: str, key: str, vector: str, tau: float) -> DataFrame:
    """(bank, i, j, p): softmax over j of -|z_i - z_j|^2 / tau within each bank, whose size is bounded by what a bank is."""
    other = vectors.select(bank, F.col(key).alias("j"), F.col(vector).alias("_w"))
    pairs = vectors.select(bank, F.col(key).alias("i"), F.col(vector).alias("_v")).join(other, bank)
    square = F.aggregate(F.zip_with("_v", "_w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select(bank, "i", "j", (-square / tau).alias("s"))
    row = Window.partitionBy(bank, "i")
    weight = scored.withColumn("w", F.exp(F.col("s") - F.max("s").over(row)))
    return weight.select(bank, "i", "j", (F.col("w") / F.sum("w").over(row)).alias("p"))


def exact_posterior(rows: DataFrame, bank: str, key: str, digest: str) -> DataFrame:
    """(bank, i, n, p): each observation is as likely as every other of its bank with an equal digest."""
    same = Window.partitionBy(bank, digest)
    return rows.select(bank, F.col(key).alias("i"), F.count("*").over(same).alias("n"), (1.0 / F.count("*").over(same)).alias("p"))
