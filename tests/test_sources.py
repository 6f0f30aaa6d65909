"""Motion CSVs, assignments and publication in a temporary folder."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tracklume.sources import assignments, motion_csv, publish


def write_csv(path, duplicate=False):
    bodies, roles = ["DARKO_Robot", "Helmet_1", "LO1"], ["robot", "visitor", "carried"]
    head = ["Frame", "Time", "LO1 - 1 X"]
    for b in bodies:
        head += [f"{b} Centroid_{a}" for a in "XYZ"] + [f"{b} R{i}" for i in range(9)]
    lines = [["FILE_ID", path.stem], ["BODY_NAMES", *bodies], ["BODY_ROLES", *roles], head]
    for i in range(3):
        row = [str(i), f"{i / 10}", "1.0"]
        for k in range(3):
            row += [str(1000.0 * (i + k)) if not (k == 2 and i == 1) else "N/A", "500", "0"] + ["0"] * 9
        lines.append(row)
    if duplicate:
        lines.append(lines[-1])
    path.write_text("\n".join(",".join(r) for r in lines) + "\n")


def test_motion_csv(spark, tmp_path):
    write_csv(tmp_path / "THOR-Magni_120522_SC1A.csv", duplicate=True)
    found = motion_csv.read_motion_csv(spark, str(tmp_path))
    rows = {(r.body, r.frame): r for r in found.collect()}
    assert rows["Helmet_1", 2].x == 3.0 and rows["Helmet_1", 2].object_type == "human"
    assert rows["DARKO_Robot", 0].object_type == "robot" and rows["LO1", 0].object_type == "carried_object"
    assert ("LO1", 1) not in rows and len(rows) == 8
    assert {r.not_increasing for r in motion_csv.hygiene(found).collect()} == {0}


def test_assignments(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"train": ["THOR-Magni_1", "2"], "validation": ["3", "2"]}')
    found = assignments.read_assignment(spark, str(tmp_path / "a.json"))
    assert sorted(map(tuple, found.collect())) == [("train", "1"), ("train", "2"), ("val", "2"), ("val", "3")]
    there = spark.createDataFrame([("1",), ("2",), ("9",)], "recording_id string")
    assert sorted(map(tuple, assignments.assignment_problems(found, there).collect())) == [("2", "duplicate"), ("3", "missing"), ("9", "extra")]


def test_publish(spark, tmp_path):
    rows = spark.range(20).selectExpr("id", "id % 3 as part")
    path = str(tmp_path / "out")
    assert publish.publish(rows, path, ["part"], ["id"]).count() == 3
    with pytest.raises(publish.AlreadyPublished):
        publish.publish(rows, path, ["part"], ["id"])
    assert publish.verify(spark, path, ["part"], ["id"]).count() == 0
    spark.range(1).write.mode("append").parquet(f"{publish.published(spark, path)}/data/part=1")
    assert [r.part for r in publish.verify(spark, path, ["part"], ["id"]).collect()] == [1, 1]


def test_writers_race(spark, tmp_path):
    """Of writers that start together one publishes, the others are told, and no folder of theirs stays."""
    rows, path = spark.range(20).selectExpr("id", "id % 3 as part"), str(tmp_path / "out")

    def one(_):
        try:
            return publish.publish(rows, path, ["part"], ["id"]).count()
        except publish.AlreadyPublished:
            return None

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(one, range(4)))
    assert sorted(x is None for x in found) == [False, True, True, True] and 3 in found
    assert len([x for x in (tmp_path / "out").iterdir() if x.name.startswith("run-")]) == 1


def test_publish_shards(spark, tmp_path):
    rows, shards = spark.range(20).selectExpr("id", "id % 5 as part"), str(tmp_path / "shards")
    assert publish.publish_shards(rows, shards, "part", 2, 0) == [0, 2, 4]
    assert publish.publish_shards(rows, shards, "part") == [1, 3]
    assert publish.publish_shards(rows, shards, "part") == []
    found = publish.read_shards(spark, shards, "part")
    assert sorted((r.id, r.part) for r in found.collect()) == [(i, i % 5) for i in range(20)]
    # A run that broke off before its commits leaves nothing behind that a reader sees.
    rows.where("part = 1").write.partitionBy("part").parquet(f"{shards}/run-broken")
    assert publish.read_shards(spark, shards, "part").count() == 20


def test_canonical_lines(spark, tmp_path):
    rows = spark.createDataFrame([(2, None, 0.5), (1, "x", None)], "b int, a string, c double")
    folder = publish.publish_lines(rows, str(tmp_path / "lines"), ["b"])
    assert [r.value for r in spark.read.text(folder).orderBy("value").collect()] == ['{"a":"x","b":1,"c":null}', '{"a":null,"b":2,"c":0.5}']
    with pytest.raises(Exception, match="no JSON for the row"):
        publish.canonical_lines(spark.createDataFrame([(1, float("nan"))], "b int, c double"), ["b"]).collect()
