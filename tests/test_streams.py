"""Streams over several triggers against their batch twins: rows out of order, late rows, stops, and batches run again."""

import datetime as dt
import random

import pytest

from tracklume.operators.segments import segments
from tracklume.sources import sealed
from tracklume.streaming import epochs, segments as M

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ROWS = "ts timestamp, object_id long, event_id long, t double"


def row(o, e, seconds):
    return START + dt.timedelta(seconds=seconds), o, e, float(seconds)


def drop(spark, folder, name, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{folder}/{name}")


def source(spark, folder):
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_segments_over_triggers(spark, tmp_path):
    """Rows up to 50 s out of order: the same segments as over the whole table, trigger by trigger and over a restart."""
    own = random.Random(3)
    rows = [row(o, 1000 * o + i, s) for o in range(4) for i, s in enumerate(sorted(own.sample(range(4000), 60)))]
    rows.sort(key=lambda r: r[3] + own.uniform(0, 50))
    beside, folder = M.stateful_session(spark), tmp_path / "in"
    for i in range(3):
        drop(spark, folder, f"a{i}", rows[i * 40 : (i + 1) * 40])
    root = str(tmp_path / "out")
    stream = lambda: M.stream_segments(source(beside, folder), 100.0, "60 seconds")
    first = M.run_to_table(stream(), "s", root=root, back=spark).count()
    assert 0 < first < 120
    drop(spark, folder, "b", rows[120:])
    drop(spark, folder, "c", [row(9, 9, 10_000)])  # moves the watermark past all others
    found = M.run_to_table(stream(), "s", root=root, back=spark).where("object_id <> 9")
    batch = segments(spark.createDataFrame(rows, ROWS), "object_id", "t", 100.0).select("object_id", "event_id", "t", "segment_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect())) and batch.agg({"segment_id": "max"}).first()[0] > 3


def test_late_rows_are_dropped(spark, tmp_path):
    beside, folder = M.stateful_session(spark), tmp_path / "in"
    for name, rows in (("a", [row(1, 1, 0), row(1, 2, 1000)]), ("b", [row(1, 3, 995), (None, 1, 5, 1.0), row(None, 6, 1001)]), ("c", [row(1, 4, 10)]), ("d", [row(2, 7, 9000)])):
        drop(spark, folder, name, rows)
    root = str(tmp_path / "out")
    M.run_to_table(M.stream_segments(source(beside, folder), 100.0, "60 seconds"), "s", root=root, back=spark)
    found = spark.read.parquet(f"{root}/data").where("object_id = 1").orderBy("t").collect()
    assert [(r.event_id, r.segment_id) for r in found] == [(1, 0), (3, 1), (2, 1)]  # 4 came after the watermark had passed it


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    sealed.seal(spark.range(23).selectExpr("id", "id * 2 as v"), path, "id", 5)
    return path


def test_epochs_go_on(spark, tmp_path, table):
    """Stopped and begun anew at any trigger, by a query that knows only its checkpoint: no row is lost or comes twice."""
    root = str(tmp_path / "out")
    stream = lambda n: epochs.epoch_stream(spark, table, "s", 3, n)
    for rows in (4, 7):
        query = stream(rows).writeStream.format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/checkpoint").trigger(processingTime="0 seconds").start()
        while len(query.recentProgress) < 3:
            query.awaitTermination(1)
        query.stop()
        at = epochs.cursor(f"{root}/checkpoint")
        assert set(at) == {"epoch", "shard", "row"}
    found = M.run_to_table(stream(9), "e", root=root, once=False).collect()
    whole = M.run_to_table(stream(1000), "e", root=str(tmp_path / "whole"), once=False).collect()
    assert len(found) == 69 and sorted(map(tuple, found)) == sorted(map(tuple, whole))
    by_epoch = {e: [r.id for r in sorted(whole, key=lambda r: r.position) if r.epoch == e] for e in range(3)}
    assert all(sorted(x) == list(range(23)) for x in by_epoch.values()) and by_epoch[0] != by_epoch[1]
    assert [r.position for r in sorted(whole, key=lambda r: r.position) if r.epoch == 2] == list(range(23))
    assert epochs.cursor(f"{root}/checkpoint") == {"epoch": 3, "shard": 0, "row": 0}


def test_broken_shards_stop_the_epochs(spark, tmp_path, table):
    entry = sealed.manifest(table)["shards"][2]
    data = open(f"{table}/shards/{entry['file']}", "rb").read()
    other = sealed.manifest(table)["shards"][1]
    open(f"{table}/shards/{entry['file']}", "wb").write(open(f"{table}/shards/{other['file']}", "rb").read())
    with pytest.raises(Exception, match="shard 2 of"):
        M.run_to_table(epochs.epoch_stream(spark, table, "s", 1, 100), "e", root=str(tmp_path / "x"), once=False)
    open(f"{table}/shards/{entry['file']}", "wb").write(data)
    sealed.seal(spark.range(0), str(tmp_path / "e"), "id", 5)
    assert M.run_to_table(epochs.epoch_stream(spark, str(tmp_path / "e"), "s", 2, 10), "e", root=str(tmp_path / "y"), once=False).count() == 0


def test_batches_are_published_once(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    drop(spark, folder, "a", [row(1, 1, 0)])
    drop(spark, folder, "b", [row(1, 2, 0)])
    for _ in range(2):
        M.publish_batches(source(spark, folder), out, checkpoint).awaitTermination()
    assert sorted((r.batch, r.event_id) for r in spark.read.parquet(out).collect()) in ([(0, 1), (1, 2)], [(0, 2), (1, 1)])
    # A batch whose commit was lost runs again, and writes the same folder.
    for name in ("1", ".1.crc"):
        (tmp_path / "check" / "commits" / name).unlink()
    M.publish_batches(source(spark, folder), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_windowed_counts(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [(START + dt.timedelta(minutes=m), kind, 1.0) for m, kind in ((1, "a"), (2, "a"), (59, "b"), (61, "a"), (200, "a"), (205, "a"))]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(folder / "x"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("recursiveFileLookup", "true").parquet(str(folder))
    found = M.run_to_table(M.windowed_counts(stream), "w", root=str(tmp_path / "out")).selectExpr("unix_seconds(start) as s", "event_type", "n").collect()
    zero = int(START.timestamp())
    assert sorted((r.s - zero, r.event_type, r.n) for r in found) == [(0, "a", 2), (0, "b", 1), (3600, "a", 1)]
