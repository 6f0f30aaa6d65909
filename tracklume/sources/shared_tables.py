"""Tables that cut a job's lineage, in the folder named by ``spark.checkpoint.dir``, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class SharedTables:
    """A folder of its own for one job; where the session names no shared folder, as in tests, a temporary one."""

    def __init__(self, spark: SparkSession, job: str):
        context = spark.sparkContext
        root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
        if not root:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tracklume-"))
            root = context.getCheckpointDir()
        self.spark, self.root = spark, f"{root.rstrip('/')}/{job}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
