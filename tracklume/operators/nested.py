"""Nested JSON as rows: every number of any depth under its dotted path, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklume.sources.shared_tables import SharedTables

#: Levels that may lie in each other; deeper documents stop the job instead of losing numbers.
DEPTH = 64


def _step(name: Column) -> Column:
    """A key as part of a path: its own dots and backslashes are escaped."""
    return F.regexp_replace(name, r"([\\.])", r"\\$1")


def flattened(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, ``path`` and ``value`` of every finite number in a column of JSON texts, at any depth.

    Keys of objects and places of arrays (from 0) are joined by dots.  Texts,
    booleans and nulls give nothing, nor do null or malformed documents.  Each
    round opens one level of all documents: objects and arrays that are left
    go on, numbers come out.  Repeated rows give repeated paths.
    """
    tables = SharedTables(rows.sparkSession, "flatten")
    path = F.when(F.col("_path") == "", F.col("_key")).otherwise(F.concat_ws(".", "_path", "_key"))
    now = rows.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.lit("").alias("_path"), F.try_parse_json(F.col(column)).alias("_v"))
    held = [f"_k{i}" for i in range(len(keys))]
    found = None
    for level in range(DEPTH + 1):
        # A variant is no column of Parquet that every reader knows: between rounds it is text.
        kind = F.schema_of_variant("_v")
        inner = now.where("_v is not null").select(*held, "_path", "_v", kind.alias("_kind"))
        numbers = inner.where(F.col("_kind").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")).select(*held, F.col("_path").alias("path"), F.try_variant_get("_v", "$", "double").alias("value"))
        numbers = tables.write(numbers.where("value is not null and not isnan(value) and abs(value) < double('infinity')"), f"numbers-{level}")
        found = numbers if found is None else found.unionByName(numbers)
        objects = inner.where("_kind like 'OBJECT%'").select(*held, "_path", F.explode(F.try_variant_get("_v", "$", "map<string,variant>")).alias("_key", "_v")).withColumn("_key", _step(F.col("_key")))
        arrays = inner.where("_kind like 'ARRAY%'").select(*held, "_path", F.posexplode(F.try_variant_get("_v", "$", "array<variant>")).alias("_at", "_v")).select(*held, "_path", F.col("_at").cast("string").alias("_key"), "_v")
        deeper = tables.write(objects.unionByName(arrays).select(*held, path.alias("_path"), F.to_json("_v").alias("_text")), f"level-{level}")
        if deeper.isEmpty():
            return found.select(*(F.col(h).alias(k) for h, k in zip(held, keys, strict=True)), "path", "value")
        now = deeper.select(*held, "_path", F.try_parse_json("_text").alias("_v"))
    raise ValueError(f"JSON nested more than {DEPTH} levels deep")
