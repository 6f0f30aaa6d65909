"""Sealed tables: what was sealed comes back, what was changed is named, and a run that broke off goes on."""

import json
import os
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest

from tracklume.sources import sealed as S

ROWS = "id long, name string, v double, xs array<double>"


def rows(spark, n=23):
    return spark.createDataFrame([(i, None if i % 5 == 0 else f"n{i}", i / 2, [float(i)] * (i % 3)) for i in range(n)], ROWS)


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    said = S.seal(rows(spark), path, "id", 5)
    found = S.read_sealed(spark, path, expected=said["digest"]).orderBy("id").collect()
    assert [tuple(r)[:4] for r in found] == [tuple(r) for r in rows(spark).collect()]
    assert [(r.shard, r.row_index) for r in found] == [divmod(i, 5) for i in range(23)]
    assert [(r.shard, r.rows, r.first, r.last) for r in S.shard_table(spark, path).collect()] == [(i, 5 if i < 4 else 3, str(5 * i), str(min(5 * i + 4, 22))) for i in range(5)]
    assert S.read_sealed(spark, path, ["v"]).columns == ["v"]
    assert sorted(r.id for r in S.read_sealed(spark, path, ["id"], between=(7, 11)).collect()) == [7, 8, 9, 10, 11]
    assert [e["shard"] for e in S.SealedReader(path, S.read_sealed(spark, path).schema, None, (7, 11)).entries] == [1, 2]
    with pytest.raises(S.AlreadySealed):
        S.seal(rows(spark), path, "id", 5)
    with pytest.raises(Exception, match="not 00"):
        S.read_sealed(spark, path, expected="00").collect()


def rewritten(path, change):
    """The file with one column's values changed."""
    with pa.memory_map(path) as held:
        table = pa.ipc.open_file(held).read_all()
    table = change(table)
    with pa.OSFile(path, "wb") as out, pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table)


def test_changes_are_named(spark, tmp_path):
    path = str(tmp_path / "t")
    said = S.seal(rows(spark), path, "id", 10)
    file = f"{path}/shards/{said['shards'][1]['file']}"
    whole = open(file, "rb").read()
    rewritten(file, lambda t: t.set_column(2, "v", pa.array([0.0] * len(t))))
    with pytest.raises(Exception, match="shard 1 of .*other contents in v"):
        S.read_sealed(spark, path).collect()
    assert S.read_sealed(spark, path, ["id", "name"]).count() == 23
    rewritten(file, lambda t: t.slice(0, 9))
    with pytest.raises(Exception, match="shard 1 of .*9 rows, not 10"):
        S.read_sealed(spark, path, ["id"]).collect()
    rewritten(file, lambda t: t.take(list(reversed(range(len(t))))))
    with pytest.raises(Exception, match="shard 1 of .*row_index"):
        S.read_sealed(spark, path, ["row_index"]).collect()
    open(file, "wb").write(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="shard 1 of"):
        S.read_sealed(spark, path).collect()
    os.remove(file)
    with pytest.raises(Exception, match="shard 1 of"):
        S.read_sealed(spark, path).collect()
    said["shards"][0]["rows"] = 9
    open(f"{path}/manifest.json", "w").write(S.canonical(said))
    with pytest.raises(Exception, match="its own digest"):
        S.read_sealed(spark, path).collect()


def test_broken_runs_go_on(spark, tmp_path):
    path = str(tmp_path / "t")
    said = S.seal(rows(spark), path, "id", 5)
    os.remove(f"{path}/manifest.json")
    kept = {e["shard"]: e["file"] for e in said["shards"] if e["shard"] != 2}
    os.remove(f"{path}/entries/000002.json")
    with pytest.raises(Exception, match="isn't complete"):
        S.read_sealed(spark, path).collect()
    again = S.seal(rows(spark), path, "id", 5)
    assert {e["shard"]: e["file"] for e in again["shards"] if e["shard"] != 2} == kept and again["digest"] != said["digest"]
    assert S.read_sealed(spark, path).count() == 23


def test_files_are_made_once(tmp_path):
    path = str(tmp_path / "a" / "x.json")
    with ThreadPoolExecutor(16) as pool:
        made = list(pool.map(lambda i: S.create_once(path, json.dumps(i)), range(64)))
    assert sum(made) == 1 and json.loads(open(path).read()) == made.index(True) and os.listdir(tmp_path / "a") == ["x.json"]


def test_nulls_ties_and_empty_tables(spark, tmp_path):
    few = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, "b"), (1, "b"), (2, "c")], "id long, name string")
    path = str(tmp_path / "t")
    S.seal(few.selectExpr("*", "7 as shard"), path, "id", 2)
    found = S.read_sealed(spark, path).orderBy("shard", "row_index").collect()
    assert [r.id for r in found] == [None, None, 1, 1, 1, 2] and S.read_sealed(spark, path, ["id"], between=(2, None)).count() == 1
    assert S.seal(few.where("false"), str(tmp_path / "e"), "id", 2)["shards"] == [] and S.read_sealed(spark, str(tmp_path / "e")).count() == 0
    S.forget(path)
    assert os.listdir(f"{path}/shards") == []


def test_families(spark, tmp_path):
    paths = {x: str(tmp_path / x) for x in ("train", "val")}
    for i, path in enumerate(paths.values()):
        S.seal(spark.createDataFrame([(1 + i, "g"), (3, f"h{i}"), (4 + i, None)], "id long, owner string"), path, "id", 10)
    digests = {x: S.manifest(p)["digest"] for x, p in paths.items()}
    found = S.isolation(S.family(spark, paths, digests), ["id"], "owner").collect()
    assert sorted(map(tuple, found)) == [("repeated_id", "3", 2, "train,val"), ("shared_group", "g", 2, "train,val")]
    with pytest.raises(S.SealError):
        S.family(spark, paths, {"train": digests["train"]})
