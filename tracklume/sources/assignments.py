"""Split assignments in JSON, and recordings found by their file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_assignment(spark: SparkSession, path: str) -> DataFrame:
    """split and recording_id of a JSON object split -> [ids]; ``validation`` is ``val``, and a leading file prefix is cut off."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("split", "ids")).select("split", F.explode("ids").alias("id"))
    return rows.select(F.when(F.col("split") == "validation", "val").otherwise(F.col("split")).alias("split"), F.regexp_replace("id", r"^THOR-Magni_", "").alias("recording_id"))


def assignment_problems(assigned: DataFrame, recordings: DataFrame) -> DataFrame:
    """recording_id and what is wrong: ``duplicate``, ``missing`` (assigned but not there) or ``extra``."""
    twice = assigned.groupBy("recording_id").count().where("count > 1").select("recording_id", F.lit("duplicate").alias("problem"))
    lost = assigned.join(recordings, "recording_id", "left_anti").select("recording_id", F.lit("missing").alias("problem"))
    more = recordings.join(assigned, "recording_id", "left_anti").select("recording_id", F.lit("extra").alias("problem"))
    return twice.union(lost.distinct()).union(more.distinct())


def recordings(spark: SparkSession, path: str, pattern: str = r"_(\d{6})_(SC\w+)\.csv$") -> DataFrame:
    """file, session_id and recording_id from file names; nothing of the files is read but their first line, which must name the same id if it is a FILE_ID."""
    first = spark.read.text(path).where(F.col("value").startswith("FILE_ID,")).select(F.col("_metadata.file_path").alias("file"), F.split("value", ",")[1].alias("file_id"))
    name = F.regexp_extract("file", r"([^/]+)\.csv$", 1)
    return first.select("file", F.regexp_extract("file", pattern, 1).alias("session_id"), name.alias("recording_id"), (F.col("file_id") == name).alias("matches"))
