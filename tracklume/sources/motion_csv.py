"""Motion-capture CSVs: ``KEY,v1,v2`` lines, then a ``Frame,Time,...`` header over a wide body of one column group a rigid body.

Read as text by Spark, so that a large file is many tasks; only the header of
each file (one row) is joined to its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklume.operators.quality import parse_number

_FIELD = r"^(.*) (Centroid_[XYZ]|R[0-8])$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """file and a map from each key of the leading lines to its values."""
    rows = _lines(spark, path).where(F.col("value").rlike(r"^[A-Z][A-Z0-9_]*,"))
    cells = F.split("value", ",")
    return rows.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct(cells[0].alias("key"), F.slice(cells, 2, F.size(cells) - 1).alias("values")))).alias("metadata"))


def object_type(body: Column, role: Column) -> Column:
    """robot, human, carried_object or unknown_dynamic, by the body's name and role."""
    low, part = F.lower(body), F.lower(F.coalesce(role, F.lit("")))
    return (
        F.when(part.contains("robot") | low.contains("robot"), "robot")
        .when(low.startswith("helmet_") | part.contains("visitor"), "human")
        .when(low.rlike(r"^lo(\d+|\b)|cart|\bbin|box|bucket") | (part == "carried"), "carried_object")
        .otherwise("unknown_dynamic")
    )


def read_motion_csv(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, time, body, role, object_type, x, y, z in metres, and the rotation r0 to r8.

    Lines without a frame and a time are left out (``hygiene`` counts them);
    ``N/A`` and the like are null, and a body whose centroid is null in a frame
    has no row there.
    """
    lines = _lines(spark, path)
    headers = lines.where(F.col("value").startswith("Frame,")).select("file", F.split("value", ",").alias("names"))
    body = lines.where(F.col("value").rlike(r"^\d+,")).withColumn("cells", F.split("value", ","))
    cells = body.join(headers, "file").select("file", F.col("cells")[0].cast("long").alias("frame"), parse_number(F.col("cells")[1]).alias("time"), F.explode(F.arrays_zip("names", "cells")).alias("c"))
    named = cells.select("file", "frame", "time", F.regexp_extract("c.names", _FIELD, 1).alias("body"), F.regexp_extract("c.names", _FIELD, 2).alias("field"), parse_number(F.col("c.cells")).alias("v")).where("body <> '' and time is not null")
    at = lambda name: F.max(F.when(F.col("field") == name, F.col("v")))
    wide = named.groupBy("file", "frame", "time", "body").agg(*((at(f"Centroid_{a}") / 1000).alias(a.lower()) for a in "XYZ"), *(at(f"R{i}").alias(f"r{i}") for i in range(9)))
    roles = metadata(spark, path).select("file", F.explode(F.map_from_arrays(F.col("metadata")["BODY_NAMES"], F.col("metadata")["BODY_ROLES"])).alias("body", "role"))
    return wide.where("x is not null and y is not null").join(roles, ["file", "body"], "left").withColumn("object_type", object_type(F.col("body"), F.col("role")))


def hygiene(samples: DataFrame) -> DataFrame:
    """Per file and body: rows, rows of one frame and time with equal or different places, and steps on which frame or time doesn't grow."""
    from pyspark.sql import Window

    order = Window.partitionBy("file", "body").orderBy("frame", "time")
    place = F.struct("x", "y", "z")
    same = (F.col("frame") == F.lag("frame").over(order)) & (F.col("time") == F.lag("time").over(order))
    marked = samples.withColumns({"_dup": F.coalesce(same, F.lit(False)), "_eq": F.coalesce(place == F.lag(place).over(order), F.lit(False)), "_back": F.coalesce((F.col("time") <= F.lag("time").over(order)) & ~same, F.lit(False))})
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return marked.groupBy("file", "body").agg(F.count("*").alias("rows"), count(F.col("_dup") & F.col("_eq")).alias("collapsed"), count(F.col("_dup") & ~F.col("_eq")).alias("conflicting"), count(F.col("_back")).alias("not_increasing"))
