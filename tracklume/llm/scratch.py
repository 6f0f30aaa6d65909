"""Tables that a job writes to cut its lineage, in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``.  Where that is unset, as
in tests on one machine, a temporary folder is made and set.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Whether Spark deletes the shuffle files of a query when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of an Arrow batch, which a JVM task and its Python worker both hold.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


#: Bytes of a small one.
SMALL = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = SMALL) -> Iterator[None]:
    """Jobs that run meanwhile pass texts to Python in batches of about ``size`` bytes."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def shared_dir(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get(KEY) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="tracklume-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Names tables of one job below a folder of its own; ``drop`` deletes those no plan reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as Parquet, read again: later actions start from the files, and survive lost executors.

        Nothing reads the shuffles behind the table again, so their files go with
        the write instead of when the driver happens to collect garbage.
        """
        before = self.spark.conf.get(FREED, "false")
        self.spark.conf.set(FREED, "true")
        try:
            df.write.parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(FREED, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def write_bytes(self, parts: Iterable[bytes], name: str) -> str:
        """A file of the shared folder, and its path, whose last part no other file has."""
        path = f"{self.root}/{self.root.rpartition('-')[2]}-{name}"
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        out = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(place)
        held = bytearray()
        for part in parts:
            held += part
            if len(held) >= 1 << 20:
                out.write(held)
                held = bytearray()
        out.write(held)
        out.close()
        return path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as the job's last table; all its other tables are deleted."""
        last = Scratch(self.spark, name)
        out = last.write(df, name)
        self.drop()
        return out

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The cluster's number of shuffle partitions, which follows the size of its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
