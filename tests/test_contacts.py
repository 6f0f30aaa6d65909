"""Clearances, rasters and contacts against plain geometry: polygons, all cells, and motion in very small steps."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tracklume.functions.footprints import Shape, clearance
from tracklume.functions.geometry_numpy import visible
from tracklume.operators import contacts as C

SIZES = [(2.0, 1.0, 0.0), (0.0, 0.0, 0.4), (1.0, 1.0, 0.0), (3.0, 0.2, 0.0)]
POSE = "x double, y double, yaw double, length double, width double, radius double"


def corners(x, y, yaw, length, width, _):
    local = np.array([[1, 1], [-1, 1], [-1, -1], [1, -1]]) * (length / 2, width / 2)
    return local @ np.array([[np.cos(yaw), np.sin(yaw)], [-np.sin(yaw), np.cos(yaw)]]) + (x, y)


def point_segment(p, a, b):
    d = b - a
    u = np.clip((p - a) @ d / max(d @ d, 1e-300), 0, 1)
    return np.linalg.norm(p - a - u * d)


def plain(a, b):
    """Signed distance of two shapes by their polygons' edges and normals."""
    p, q = corners(*a), corners(*b)
    axes = [np.array([math.cos(yaw + k), math.sin(yaw + k)]) for yaw in (a[2], b[2]) for k in (0, math.pi / 2)]
    gaps = [max((q @ n).min() - (p @ n).max(), (p @ n).min() - (q @ n).max()) for n in axes]
    if max(gaps) > 1e-12:
        gap = min(point_segment(v, r[i], r[(i + 1) % 4]) for s, r in ((p, q), (q, p)) for v in s for i in range(4))
    else:
        gap = max(gaps)
    return gap - a[5] - b[5]


def shapes(own, n, spread=3.0):
    return [(own.uniform(-spread, spread), own.uniform(-spread, spread), own.uniform(-4, 4), *own.choice(SIZES)) for _ in range(n)]


def packed(prefix):
    return Shape(*(F.col(f"{prefix}.{x.split()[0]}") for x in POSE.split(", ")))


def pairs(spark, left, right):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(left, right, strict=True))], f"k int, a struct<{POSE.replace(' double', ': double')}>, b struct<{POSE.replace(' double', ': double')}>")


def test_clearance(spark):
    own = random.Random(2)
    left, right = shapes(own, 400), shapes(own, 400)
    # Touching, inside, alike, and apart by a corner.
    left += [(0.0, 0.0, 0.0, 2.0, 2.0, 0.0)] * 4
    right += [(2.0, 0.0, 0.0, 2.0, 2.0, 0.0), (0.25, 0.0, 0.0, 1.0, 1.0, 0.0), (0.0, 0.0, 0.0, 2.0, 2.0, 0.0), (4.0, 5.0, 0.0, 2.0, 2.0, 0.0)]
    found = pairs(spark, left, right).select("k", clearance(packed("a"), packed("b")).alias("c"), clearance(packed("b"), packed("a")).alias("d")).orderBy("k").collect()
    wanted = [plain(a, b) for a, b in zip(left, right, strict=True)]
    assert np.allclose([r.c for r in found], wanted, atol=1e-9) and np.allclose([r.d for r in found], wanted, atol=1e-9)
    assert [r.c for r in found[-4:]] == [0.0, -1.25, -2.0, math.hypot(2, 3)]


def test_boxes_and_inflation(spark):
    own = random.Random(3)
    left = shapes(own, 50)
    a = packed("a")
    grown = a.inflated(0.5)
    rows = pairs(spark, left, left).select("k", F.array(*a.box()).alias("box"), F.array(*(v for c in a.corners() for v in c)).alias("corners"), grown.length.alias("l"), grown.radius.alias("r"), a.reach().alias("reach")).orderBy("k").collect()
    for shape, r in zip(left, rows, strict=True):
        p = corners(*shape)
        assert np.allclose(np.array(r.corners).reshape(4, 2), p)
        assert np.allclose(r.box, [p[:, 0].min() - shape[5], p[:, 0].max() + shape[5], p[:, 1].min() - shape[5], p[:, 1].max() + shape[5]])
        assert (r.l, r.r) == ((0.0, shape[5] + 0.5) if shape[3] == 0 else (shape[3] + 1, shape[5]))
        assert np.isclose(r.reach, np.linalg.norm(p - shape[:2], axis=1).max() + shape[5])


def test_rasters(spark):
    own = random.Random(4)
    left = [*shapes(own, 30, 2.5), (0.5, 0.5, 0.0, 1.0, 1.0, 0.0), (40.0, 0.0, 0.0, 1.0, 1.0, 0.0)]
    rows = pairs(spark, left, left).unionByName(spark.sql("select 99 as k, null as a, null as b").select("k", F.lit(None).cast(f"struct<{POSE.replace(' double', ': double')}>").alias("a"), F.lit(None).cast(f"struct<{POSE.replace(' double', ': double')}>").alias("b")))
    found = {(r.k, r.row, r.col) for r in C.touched_cells(rows, ["k"], packed("a"), 0.5, 8, 12).collect()}
    cell = lambda r, c: ((c + 0.5 - 6) * 0.5, (r + 0.5 - 4) * 0.5, 0.0, 0.5, 0.5, 0.0)
    assert found == {(k, r, c) for k, a in enumerate(left) for r in range(8) for c in range(12) if plain(a, cell(r, c)) <= 1e-12}
    assert len([x for x in found if x[0] == 30]) == 16  # closed squares: a square of 2 x 2 cells touches those around it


def test_box_join(spark):
    own = random.Random(5)
    left = spark.createDataFrame([(i, own.randrange(2), own.uniform(-9, 9), own.uniform(-9, 9), own.uniform(0, 6)) for i in range(60)] + [(60, 0, None, 0.0, 1.0)], "i int, g int, x double, y double, d double")
    right = spark.createDataFrame([(j, own.randrange(2), own.uniform(-9, 9), own.uniform(-9, 9)) for j in range(80)] + [(80, 0, None, 0.0)], "j int, g int, u double, v double")
    box = F.col("x") - F.col("d"), F.col("x") + F.col("d"), F.col("y") - F.col("d"), F.col("y") + F.col("d")
    found = C.box_join(left, right, ["g"], box, F.col("u"), F.col("v"), 2.0)
    plain_ = left.join(right, "g").where("abs(x - u) <= d and abs(y - v) <= d")
    assert sorted((r.i, r.j) for r in found.collect()) == sorted((r.i, r.j) for r in plain_.collect()) and found.columns == ["g", "i", "x", "y", "d", "j", "u", "v"]


def on_the_way(a, b, t):
    turn = (b[2] - a[2] + math.pi) % (2 * math.pi) - math.pi
    return (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]), a[2] + t * turn, *a[3:])


def test_contacts(spark):
    own = random.Random(6)
    ways = []
    for _ in range(60):
        a, b = shapes(own, 2)
        ways.append((a, (*shapes(own, 1)[0][:3], *a[3:]), b, (*shapes(own, 1)[0][:3], *b[3:])))
    # Past each other at a hair's breadth, at rest in contact, and through each other between the ends.
    disc = (0.0, 0.0, 0.5)
    ways += [((-2.0, 0.0, 0.0, *disc), (2.0, 0.0, 0.0, *disc), (2.0, 1.01, 0.0, *disc), (-2.0, 1.01, 0.0, *disc)), ((0.0, 0.0, 0.0, *disc),) * 2 + ((1.0, 0.0, 0.0, *disc),) * 2, ((-5.0, 0.0, 0.0, *disc), (5.0, 0.0, 0.0, *disc), (0.0, -5.0, 0.0, *disc), (0.0, 5.0, 0.0, *disc))]
    kind = f"struct<{POSE.replace(' double', ': double')}>"
    rows = spark.createDataFrame([(i, *w) for i, w in enumerate(ways)] + [(99, None, None, None, None)], f"k int, a0 {kind}, a1 {kind}, b0 {kind}, b1 {kind}")
    found = {r.k: r for r in C.contacts(rows, ["k"], (packed("a0"), packed("a1")), (packed("b0"), packed("b1"))).collect()}
    for k, (a0, a1, b0, b1) in enumerate(ways):
        gaps = np.array([plain(on_the_way(a0, a1, t), on_the_way(b0, b1, t)) for t in np.linspace(0, 1, 401)])
        r, touching = found[k], np.flatnonzero(gaps <= 0)
        if len(touching):  # no contact is missed, and the first is not later than what the steps see
            assert r.contact and r.after <= touching[0] / 400 + 1e-9
            assert touching[0] == 0 or gaps[: max(0, int(r.after * 400) - 1)].min(initial=1) > 0
        elif gaps.min() > 0.05:
            assert not r.contact
        if not r.contact:
            assert gaps.min() > 0 and (r.after, r.upto) == (None, None)
    assert (found[60].contact, found[61].upto, found[62].contact, found[99].contact) == (False, 0.0, True, False)
    assert C.contacts(rows.limit(0), ["k"], (packed("a0"), packed("a1")), (packed("b0"), packed("b1"))).count() == 0


def test_sight():
    grid = np.zeros((5, 5), bool)
    grid[2, 3] = True
    seen = visible(grid, 2, 2)
    assert seen[2, 3] and not seen[2, 4] and seen[0, 0]
    corner = np.zeros((3, 3), bool)
    corner[0, 1] = True
    assert not visible(corner, 0, 0)[1, 1]  # either side cell of a corner blocks
    own = np.random.default_rng(1)
    for _ in range(20):
        blocked = own.random((9, 7)) < 0.2
        seen = visible(blocked, 4, 3)
        for r in range(9):
            for c in range(7):
                # Closed squares of all cells that the line touches more than at its ends' cells.
                line = [(4 + t * (r - 4), 3 + t * (c - 3)) for t in np.linspace(0, 1, 2521)]
                cells = {(i, j) for y, x in line for i in {math.floor(y + 0.5), math.ceil(y - 0.5)} for j in {math.floor(x + 0.5), math.ceil(x - 0.5)} if abs(y - i) <= 0.5 and abs(x - j) <= 0.5}
                on_border = r == 4 or c == 3  # such lines run inside cells
                if on_border or seen[r, c]:
                    inner = {(i, j) for i, j in cells if (i, j) not in ((4, 3), (r, c))}
                    assert not seen[r, c] or not any(blocked[i, j] for i, j in inner if 0 <= i < 9 and 0 <= j < 7)
