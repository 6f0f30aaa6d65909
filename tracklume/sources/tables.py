"""Readers of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor directory, as Spark's own Parquet source reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
