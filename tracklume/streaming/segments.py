"""Streaming twins of the track operators: gap segments with event-time state, windowed counts, and exactly-once publication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tracklume.sources.shared_tables import SharedTables

_OUT = "object_id long, event_id long, t double, segment_id long"
#: Groups that objects are dealt into by their hash; a checkpoint holds for this number only.
GROUPS = 1024
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside this one, of the same application, whose streams may keep named state and timers: these need RocksDB."""
    beside = spark.newSession()
    beside.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        beside.conf.set(key, spark.conf.get(key))
    return beside


class _Segmenter(StatefulProcessor):
    """Rows wait, those of a group of objects together, until the watermark has passed them; then they are in order, whenever they came."""

    def __init__(self, max_gap: float):
        self.max_gap = max_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "object_id long, event_id long, t double, ms long")
        self.open = handle.getListState("open", "object_id long, t double, segment long")
        self.due = handle.getValueState("due", "ms long")

    def _wait(self, ms: int) -> None:
        """One timer a group, at the first row that waits."""
        known = self.due.get() if self.due.exists() else None
        if known is None or ms < known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            kinds = {"object_id": int, "event_id": int, "t": float, "ms": int}
            self.waiting.appendList(list(zip(*(frame[c].astype(k).tolist() for c, k in kinds.items()), strict=True)))
            self._wait(int(frame["ms"].min()))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = pd.DataFrame(list(self.waiting.get()), columns=["object_id", "event_id", "t", "ms"])
        ready = rows[rows["ms"] <= mark].sort_values(["object_id", "t", "event_id"])
        later = rows[rows["ms"] > mark]
        self.waiting.clear()
        self.due.clear()
        if len(later):
            self.waiting.appendList(list(later.itertuples(index=False, name=None)))
            self._wait(int(later["ms"].min()))
        if len(ready):
            ids, t = ready["object_id"].to_numpy(), ready["t"].to_numpy()
            known = {o: (last, segment) for o, last, segment in self.open.get()}
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            before = [known.get(o, (at, 0)) for o, at in zip(ids[first].tolist(), t[first].tolist(), strict=True)]
            steps = np.diff(t, prepend=t[:1])
            steps[first] = t[first] - [last for last, _ in before]
            jumps = (steps > self.max_gap).cumsum()
            sizes = np.diff(np.r_[first, len(ids)])
            ahead = jumps[first] - (steps[first] > self.max_gap)
            found = jumps + np.repeat([segment for _, segment in before] - ahead, sizes)
            ends = first + sizes - 1
            known |= dict(zip(ids[ends].tolist(), zip(t[ends].tolist(), found[ends].tolist(), strict=True), strict=True))
            self.open.put([(o, *x) for o, x in known.items()])
            yield pd.DataFrame({"object_id": ids, "event_id": ready["event_id"].to_numpy(), "t": t, "segment_id": found})

    def close(self) -> None:
        pass


def stream_segments(track: DataFrame, max_gap: float, late: str, eps: float = 1e-9) -> DataFrame:
    """object_id, event_id, t, segment_id of a stream of (ts, object_id, event_id, t): a new segment after each gap, as over the whole table at once.

    ``ts`` is the row's time for the watermark, ``t`` the same in seconds.  A
    row comes out when the watermark, ``late`` behind the latest row, has
    passed it; so rows may come in any order within ``late``, and later ones
    are dropped by Spark.  State is what waits, and an object's last time and
    segment; it is read and written by groups of objects, of which there are
    ``GROUPS``, as a call for each object costs more than its rows.  Null objects and times are left out.
    """
    marked = track.where("object_id is not null and ts is not null").withWatermark("ts", late).withColumn("ms", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000))
    grouped = marked.withColumn("_group", F.pmod(F.xxhash64(F.col("object_id").cast("long")), F.lit(GROUPS))).groupBy("_group")
    processor = _Segmenter(max_gap + eps)
    return grouped.transformWithStateInPandas(processor, _OUT, "append", "EventTime")


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of (ts, event_type, value) by window and type, when the watermark has passed the window; rows later than ``late`` are left out."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_to_table(stream: DataFrame, name: str, mode: str = "append", root: str | None = None, once: bool = True, back: SparkSession | None = None) -> DataFrame:
    """Runs a stream over all that is there now, into Parquet in the shared folder; returns the table.

    The checkpoint stands beside the data: a second call with the same ``root``
    goes on where the first one ended.  Where not ``once``, the source deals
    its rows out by itself, trigger by trigger.  ``back`` is the session that
    reads the table, if not the stream's own.
    """
    spark: SparkSession = stream.sparkSession
    place = root or SharedTables(spark, f"stream-{name}").root
    writer = stream.writeStream.format("parquet").option("path", f"{place}/data").option("checkpointLocation", f"{place}/checkpoint").outputMode(mode)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="0 seconds")).start()
    try:
        query.awaitTermination() if once else query.processAllAvailable()
    finally:
        query.stop()
    return (back or spark).read.schema(stream.schema).parquet(f"{place}/data")


def publish_batches(stream: DataFrame, path: str, checkpoint: str):
    """Exactly-once publication: each micro-batch overwrites its own folder, so a batch that is run again changes nothing."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
