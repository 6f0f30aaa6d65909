"""Headings, contracts and strict joins on small frames, against numpy and by hand."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklume.operators import base_states as B
from tracklume.operators import headings as H
from tracklume.operators import strict as T
from tracklume.sources import sealed as S


def plain_heading(t, vx, vy):
    moving = np.flatnonzero(np.hypot(vx, vy) > 1e-6)
    return np.interp(t, t[moving], np.unwrap(np.arctan2(vy[moving], vx[moving]))) if len(moving) else None


def test_headings(spark):
    own, rows, wanted = np.random.default_rng(5), [], {}
    for g in range(12):
        n = int(own.integers(1, 30))
        t = np.cumsum(own.uniform(0.1, 1, n))
        v = own.normal(size=(2, n)) * (own.random(n) < (0.0 if g == 3 else 0.5))
        rows += [(g, float(a), float(b), float(c)) for a, b, c in zip(t, *v, strict=True)]
        wanted[g] = plain_heading(t, *v)
    found = H.motion_heading(spark.createDataFrame(rows, "g int, t double, vx double, vy double"), ["g"], "t", "vx", "vy").orderBy("g", "t").collect()
    for g, angles in wanted.items():
        got = [r.heading for r in found if r.g == g]
        assert got == [None] * len(got) if angles is None else np.allclose(got, angles)


def test_orientation_falls_back(spark):
    samples = spark.createDataFrame([(g, float(t), *v) for g in (1, 2, 3) for t, v in enumerate(((0.0, 0.0), (1.0, 1.0), (0.0, 0.0)))] + [(4, 0.0, 0.0, 0.0), (4, 1.0, 0.0, None)], "g int, t double, vx double, vy double")
    measured = spark.createDataFrame([(1, 0.5, 3.0), (1, 1.5, -3.0), (1, 1.0, None), (2, 1.0, None), (2, 2.0, float("nan"))], "g int, t double, yaw double")
    found = H.oriented(samples.withColumn("source", F.lit(1)), measured, ["g"], "t", "yaw", "vx", "vy").orderBy("g", "t").collect()
    assert [(r.g, r.source) for r in found] == [(1, "measured")] * 3 + [(2, "motion")] * 3 + [(3, "motion")] * 3 + [(4, "zero")] * 2
    turned = 3.0 + (2 * np.pi - 6.0) / 2  # the shorter way from 3 to -3
    assert np.allclose([r.yaw for r in found], [3.0, turned, 2 * np.pi - 3.0, *[np.pi / 4] * 6, 0.0, 0.0])
    told = {r.g: tuple(r)[1:] for r in H.sources(H.oriented(samples, measured, ["g"], "t", "yaw", "vx", "vy").withColumn("g", F.col("g") % 2), ["g"]).collect()}
    assert told == {0: (0, 3, 2, "mixed"), 1: (3, 3, 0, "mixed")}


def test_time_contract(spark):
    rows = [(1, 0, 0.0), (1, 0, 0.2), (1, 0, 0.5), (1, 1, 5.0), (1, 1, 5.0), (1, 0, 6.0), (1, 0, None), (2, 0, 1.0)]
    found = H.time_violations(spark.createDataFrame(rows, "g int, s int, t double"), ["g"], "s", "t", 0.2)
    assert {(r.rule, r.g): r.n for r in found.collect()} == {("unknown_time", 1): 1, ("uneven_step", 1): 2, ("not_increasing", 1): 1, ("segment_returns", 1): 1}
    sums = H.sum_violations(spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.9), (3, 1.5), (3, -0.5), (4, 1.0), (4, None)], "g int, p double"), ["g"], "p")
    assert sorted((r.rule, r.g) for r in sums.collect()) == [("negative", 3), ("sum_off", 2), ("unknown", 4)]


def test_complete_join(spark):
    of = lambda rows: spark.createDataFrame(rows, "k int, v string")
    tables = {"a": of([(1, "x"), (2, "y"), (None, "n")]), "b": of([(1, "p"), (3, "q"), (None, "m")]), "c": of([(1, "c"), (3, "d"), (3, "e"), (None, "o")])}
    joined = T.complete_join(tables, ["k"])
    found = {r.k: (r.state, r.a and r.a.v, r.b and r.b.v) for r in joined.collect()}
    assert found == {1: ("complete", "x", "p"), 2: ("missing:b,c", "y", None), 3: ("missing:a repeated:c", None, "q"), None: ("complete", "n", "m")}
    assert T.require_complete(joined.where("state = 'complete'"), ["k"]).count() == 2
    with pytest.raises(Exception, match='"k":[23]} is missing'):
        T.require_complete(joined, ["k"]).collect()
    assert T.complete_join({n: t.where("false") for n, t in tables.items()}, ["k"]).count() == 0


def test_revalued(spark):
    facts = spark.createDataFrame([(1, 0, None), (2, 1, 5.0), (3, None, 1.0)], "k int, y int, v double")
    records = spark.createDataFrame([(1, 1, 2.0), (3, None, 1.0), (9, 1, 1.0)], "k int, y int, v double")
    assert [tuple(r) for r in T.revalued(facts, records, ["k"], ["y", "v"]).orderBy("k").collect()] == [(1, 1, 2.0, True, ["y=0", "v=null"]), (2, 1, 5.0, False, []), (3, None, 1.0, True, [])]


def test_variants(spark):
    texts = ['{"kind":"circle","radius_m":0.5}', '{"radius_m":0.5,"kind":"circle"}', '{"kind":"circle","radius_m":-1}', '{"kind":"circle","radius_m":1,"width_m":2}', '{"kind":"blob"}', "{", None, '{"kind":"rectangle","length_m":2,"width_m":1}', '{"kind":"rectangle","length_m":2}', '[1]', '"circle"']
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", T.footprint_struct(F.col("x")).alias("s"))
    back = rows.select("i", "s", T.footprint_json(F.col("s.kind"), {f: F.col(f"s.{f}") for f in ("radius_m", "length_m", "width_m")}).alias("x")).orderBy("i").collect()
    assert [r.i for r in back if r.s is not None] == [0, 1, 7] and [r.x for r in back if r.x] == [texts[0], texts[0], '{"kind":"rectangle","length_m":2.0,"width_m":1.0}']
    with pytest.raises(ValueError, match="no column z"):
        T.allowed(rows, ["i", "z"])
    told = spark.createDataFrame([('{"a":{"b":"x"}}',), ('{"a":{}}',), (None,), ("{",)], "p string").select(T.slice_key(F.col("p"), "$.a.b").alias("v")).collect()
    assert [r.v for r in told] == ["x", "unavailable", "unavailable", "unavailable"]


def test_sealed_places_and_ids(spark, tmp_path):
    path = str(tmp_path / "t")
    S.seal(spark.range(23).selectExpr("id * 2 as id", "id as v"), path, "id", 5)
    assert sorted(r.v for r in S.read_rows(spark, path, 8, 5, ["v"]).collect()) == [8, 9, 10, 11, 12]
    assert S.read_rows(spark, path, 20, 50).count() == 3 and S.read_rows(spark, path, 99, 5).count() == 0
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "i long")
    assert sorted(r.v for r in S.read_ids(spark, path, ids(4, 4, 40, None), "i").collect()) == [2, 20]
    with pytest.raises(Exception, match="no row for 5"):
        S.read_ids(spark, path, ids(4, 5), "i").collect()


def test_base_states(spark):
    """A robot with a gap, and objects whose islands end before, at, and behind what a decision needs."""
    robot = [(0, s, t, float(t), 0.0, 0.0) for s, ticks in ((0, range(12)), (1, range(20, 32))) for t in ticks]
    spans = {"whole": range(12), "late": range(3, 12), "short": range(9), "far": range(12), "broken": [*range(5), *range(6, 12)]}
    objects = [(0, 0, t, o, 500.0 if o == "far" else 1.0, float(t), 0.5) for o, ticks in spans.items() for t in ticks] + [(0, 0, None, "nowhere", 0.0, 0.0, 0.0)]
    kinds = "recording int, segment int, tick int"
    frames = spark.createDataFrame(robot, f"{kinds}, x double, y double, yaw double"), spark.createDataFrame(objects, f"{kinds}, object_id string, x double, y double, yaw double")
    where = ["recording", "segment", "tick", 3, 4, 1]
    made = B.decisions(frames[0], *where)
    assert sorted((r.tick, r.accepted) for r in made.collect()) == [(t, 2 <= t <= 7 or 22 <= t <= 27) for t in [*range(2, 12), *range(20, 28)]]
    attached = B.base_states(*frames, *where, 60.0)
    found = {(r.tick, r.object_id): (r.visible, r.oracle, len(r.past), r.coming and len(r.coming)) for r in attached.collect()}
    wanted = {}
    for o, ticks in spans.items():
        for t in range(2, 8):
            if all(t - i in ticks for i in range(3)):
                oracle = all(t + i in ticks for i in range(1, 5))
                visible = o != "far"
                if visible or oracle:
                    wanted[t, o] = (visible, oracle, 3, 4 if oracle else None)
    assert found == wanted
    some = next(r for r in attached.collect() if (r.tick, r.object_id) == (4, "whole"))
    assert [(p.x, p.y) for p in some.past] == [(-3.0, 2.0), (-3.0, 3.0), (-3.0, 4.0)]
    assert tuple(B.funnel(made, attached, "recording", "tick").first()) == (0, 18, 12, 6, 6)
    assert sorted(map(tuple, B.islands(frames[1].where("object_id = 'broken' or tick is null"), ["object_id"], "tick").collect())) == [("broken", 0, 4, 5), ("broken", 6, 11, 6)]
    assert B.base_states(frames[0], frames[1].where("false"), *where, 60.0).count() == 0
