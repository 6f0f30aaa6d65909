"""Streams over the events and over sealed orders, run until all that is there has been read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklume.plans.track_queries import DAY, SEGMENTED
from tracklume.sources import sealed
from tracklume.sources.shared_tables import SharedTables
from tracklume.sources.tables import table
from tracklume.streaming import epochs
from tracklume.streaming import segments as M

SEED, EPOCHS, SHARD = "3", 2, 5_000


def _events(spark, sf_dir):
    """The events as a file stream; files are matched by name, so that the folder's other tables stay out."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_track_segments(spark, sf_dir):
    """Segments in the order of events' times, whenever they come."""
    rows = _events(M.stateful_session(spark), sf_dir).select("ts", F.col("user_id").alias("object_id"), "event_id", (F.unix_micros("ts") / 1e6).alias("t"))
    return M.run_to_table(M.stream_segments(rows, DAY, "0 seconds"), "segments", back=spark)


def stream_windowed_counts(spark, sf_dir):
    """Hourly counts and sums by kind, of the hours that the watermark, ten minutes behind the last event, has passed."""
    found = M.run_to_table(M.windowed_counts(_events(spark, sf_dir)), "windows")
    return found.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def stream_epochs(spark, sf_dir):
    """Two epochs over sealed orders, each in an order of its own, some shards a trigger."""
    path = f"{SharedTables(spark, 'stream-sealed').root}/table"
    said = sealed.seal(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), path, "o_orderkey", SHARD)
    stream = epochs.epoch_stream(spark, path, SEED, EPOCHS, 7 * SHARD // 2 + len(said["shards"]) * SHARD // 4, said["digest"])
    return M.run_to_table(stream, "epochs", once=False).select("epoch", "position", "shard", "o_orderkey")


QUERIES = {f.__name__: f for f in (stream_track_segments, stream_windowed_counts, stream_epochs)}
ORACLE = {
    "stream_track_segments": f"with {SEGMENTED} select object_id, event_id, t, segment_id from segmented",
    "stream_windowed_counts": """select epoch(date_trunc('hour', ts))::bigint as start, event_type, count(*) as n, round(sum(value), 6) as total from events
group by all having date_trunc('hour', any_value(ts)) + interval 1 hour <= (select max(ts) - interval 10 minute from events)""",
    "stream_epochs": f"""with o as (select o_orderkey, cast((row_number() over (order by o_orderkey) - 1) // {SHARD} as bigint) as shard from orders)
select e as epoch, row_number() over (partition by e order by sha256('{SEED}|' || e || '|' || shard), shard, sha256('{SEED}|' || e || '|' || o_orderkey)) - 1 as position, shard, o_orderkey from o, generate_series(0, {EPOCHS - 1}) s(e)""",
}
