"""What a task holds, and what is shuffled, as tables grow."""

from pyspark.sql import functions as F

from tracklume.operators import tracks as K
from tracklume.operators.segments import segments
from tracklume.plans import catalogue, contact_queries, track_queries
from tracklume.sources import sealed
from tracklume.streaming import segments as M

SF = "/root/testdata/sf0.001"


def test_tasks_of_tracks_stay_small(spark, monkeypatch):
    rows = spark.range(10_000).select((F.col("id") % 97).alias("k"), F.col("id").alias("t"))
    parts = K.dealt(rows, ["k"], 500).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.collect_set("k").alias("ks")).collect()
    assert max(r.n for r in parts) < 1_500 and sum(r.n for r in parts) == 10_000
    assert sum(len(r.ks) for r in parts) == 97  # no key is cut
    whole = {q: sorted(map(str, catalogue.queries()[q](spark, SF).collect())) for q in ("orientation_sources", "object_orientation")}
    dealt = K.dealt
    monkeypatch.setattr(K, "dealt", lambda rows, keys: dealt(rows, keys, 50))
    assert track_queries.segmented(spark, SF).rdd.getNumPartitions() > 4
    for q, found in whole.items():
        assert sorted(map(str, catalogue.queries()[q](spark, SF).collect())) == found


def test_robots_come_to_the_others(spark, monkeypatch):
    plans = []
    found = contact_queries.C.contacts
    monkeypatch.setattr(contact_queries.C, "contacts", lambda ways, *a: plans.append(ways._jdf.queryExecution().executedPlan().toString()) or found(ways, *a))
    contact_queries.moving_contacts(spark, SF).collect()
    assert plans[0].count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plans[0]


def test_small_shards_are_read_together(spark, tmp_path):
    path = str(tmp_path / "t")
    sealed.seal(spark.range(1_000).selectExpr("id", "id * 2 as v"), path, "id", 10)
    found = sealed.read_sealed(spark, path)
    assert found.rdd.getNumPartitions() == 1 and sorted(map(tuple, found.select("id", "v", "shard", "row_index").collect())) == [(i, 2 * i, i // 10, i % 10) for i in range(1_000)]
    assert [[e["rows"] for e in x] for x in sealed.runs([{"rows": n} for n in (3, 3, 3, 9, 1)], 6)] == [[3, 3], [3], [9], [1]]


def test_objects_of_a_stream_share_state(spark, tmp_path, monkeypatch):
    """Many objects in few groups, over triggers: the segments of the whole table, and a row is out once the watermark has passed it."""
    monkeypatch.setattr(M, "GROUPS", 2)
    beside, rows = M.stateful_session(spark), [(o, 100 * o + i, s + o + 1) for o in range(12) for i, s in enumerate((0, 50, 400, 420, 900))]
    kind = "object_id long, event_id long, t double"
    for k in range(3):
        part = [(o, e, float(t)) for o, e, t in rows if k * 400 <= t < (k + 1) * 400]
        spark.createDataFrame(part, kind).selectExpr("timestamp_seconds(t) as ts", "*").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = beside.readStream.schema(f"ts timestamp, {kind}").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = sorted(map(tuple, M.run_to_table(M.stream_segments(stream, 100.0, "0 seconds"), "s", root=str(tmp_path / "out"), back=spark).collect()))
    whole = segments(spark.createDataFrame([(o, e, float(t)) for o, e, t in rows], kind), "object_id", "t", 100.0)
    assert found == sorted(map(tuple, whole.select("object_id", "event_id", "t", "segment_id").collect()))
    waiting = beside.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/out/checkpoint")
    assert waiting.select("key").distinct().count() <= 2
