"""Spatial hash joins, conservative rasters, and contacts of moving footprints found by rounds of interval refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklume.functions.footprints import Shape, clearance
from tracklume.sources.shared_tables import SharedTables

Box = tuple[Column, Column, Column, Column]


def tiled(rows: DataFrame, box: Box, tile: float) -> DataFrame:
    """``rows`` once for each tile that their box (x0, x1, y0, y1) touches: adds ``_tx`` and ``_ty``.  Rows of a null box go."""
    x0, x1, y0, y1 = (F.floor(v / tile) for v in box)
    return rows.withColumn("_tx", F.explode(F.sequence(x0, x1))).withColumn("_ty", F.explode(F.sequence(y0, y1)))


def box_join(left: DataFrame, right: DataFrame, on: list[str], box: Box, x: Column, y: Column, tile: float) -> DataFrame:
    """Pairs of equal ``on`` whose right point lies in the left box, each once: an equi-join on tiles, then the test.

    A right row has one tile and a left row those of its box, so the work
    follows the pairs that are near each other, and not all that share ``on``.
    """
    places = right.withColumns({"_tx": F.floor(x / tile), "_ty": F.floor(y / tile), "_px": x, "_py": y})
    spread = tiled(left.withColumns(dict(zip(("_x0", "_x1", "_y0", "_y1"), box, strict=True))), box, tile)
    met = spread.join(places, [*on, "_tx", "_ty"])
    return met.where("_px between _x0 and _x1 and _py between _y0 and _y1").drop("_tx", "_ty", "_px", "_py", "_x0", "_x1", "_y0", "_y1")


def grown(box: Box, margin: Column | float) -> Box:
    x0, x1, y0, y1 = box
    return x0 - margin, x1 + margin, y0 - margin, y1 + margin


def touched_cells(rows: DataFrame, keys: list[str], shape: Shape, resolution: float, height: int, width: int) -> DataFrame:
    """keys, row and col of every cell of a centred grid whose closed square a footprint touches: the cells of its box, and then the exact test."""
    x0, x1, y0, y1 = grown(shape.box(), 1e-9)
    low = lambda v, n: F.greatest(F.floor(v / resolution + n / 2), F.lit(0))
    high = lambda v, n: F.least(F.floor(v / resolution + n / 2), F.lit(n - 1))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b))
    near = rows.withColumn("row", F.explode(span(low(y0, height), high(y1, height)))).withColumn("col", F.explode(span(low(x0, width), high(x1, width))))
    cell = cell_shape(F.col("row"), F.col("col"), resolution, height, width)
    return near.where(clearance(shape, cell) <= 1e-12).select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


def cell_shape(row: Column, col: Column, resolution: float, height: int, width: int) -> Shape:
    """A cell's square."""
    side, none = F.lit(float(resolution)), F.lit(0.0)
    return Shape((col + 0.5 - width / 2) * resolution, (row + 0.5 - height / 2) * resolution, none, side, side, none)


def swept_box(start: Shape, end: Shape) -> Box:
    """A box around all that a footprint touches on its way."""
    margin = start.reach()
    return F.least(start.x, end.x) - margin, F.greatest(start.x, end.x) + margin, F.least(start.y, end.y) - margin, F.greatest(start.y, end.y) + margin


def contacts(ways: DataFrame, keys: list[str], a: tuple[Shape, Shape], b: tuple[Shape, Shape], depth: int = 12) -> DataFrame:
    """Whether two footprints that move from pose to pose at the same time touch, for each row of ``ways`` (unique ``keys``).

    keys, ``contact``, ``sure``, ``after`` and ``upto`` (the share of the way
    in which the first contact lies; null without one) and ``least``, the least
    clearance looked at.  Rounds over a table of intervals: one whose ends are
    further apart than both footprints can move in it is free; one whose end
    touches is a contact; others are cut in halves, those behind a known
    contact of their way excepted.  An interval that is still open after
    ``depth`` halvings counts as a contact that is not ``sure``.  Each round is
    written, so lineage and plans stay short.
    """
    tables = SharedTables(ways.sparkSession, "contacts")
    poses = [*a, *b]
    pose = lambda p: F.struct(*(getattr(p, f).alias(f) for f in ("x", "y", "yaw", "length", "width", "radius")))
    packed = [pose(p).alias(f"_{i}") for i, p in enumerate(poses)]
    at = lambda i: Shape(*(F.col(f"_{i}")[f] for f in ("x", "y", "yaw", "length", "width", "radius")))
    a0, a1, b0, b1 = (at(i) for i in range(4))
    state = {"_lo": F.lit(0.0), "_hi": F.lit(1.0), "_clo": clearance(a0, b0), "_chi": clearance(a1, b1), "_move": a0.motion(a1) + b0.motion(b1)}
    front = ways.select(*keys, *packed).withColumns(state)
    seen, touched = None, (F.col("_clo") <= 0) | (F.col("_chi") <= 0)
    possible = F.col("_clo") + F.col("_chi") <= F.col("_move") * (F.col("_hi") - F.col("_lo"))
    for level in range(depth + 1):
        front = tables.write(front.withColumns({"_touched": touched, "_open": ~touched & possible}), f"round-{level}")
        told = front.select(*keys, "_lo", "_hi", "_clo", "_touched", F.least("_clo", "_chi").alias("_least"), (F.col("_open") & F.lit(level == depth)).alias("_left"))
        seen = told if seen is None else seen.unionByName(told)
        if level == depth or front.where("_open").isEmpty():
            break
        known = front.where("_touched").groupBy(*keys).agg(F.min("_hi").alias("_known"))
        later = front.where("_open").join(known, keys, "left").where("_known is null or _lo < _known").drop("_known", "_touched", "_open")
        # Poses first, as columns of their own: the clearance names each of their parts many times.
        halfway = later.withColumn("_mid", (F.col("_lo") + F.col("_hi")) / 2)
        posed = halfway.withColumns({"_am": pose(a0.between(a1, F.col("_mid"))), "_bm": pose(b0.between(b1, F.col("_mid")))})
        middle = posed.withColumn("_cmid", clearance(at("am"), at("bm"))).drop("_am", "_bm")
        half = F.explode(F.array(F.struct(F.col("_lo").alias("a"), F.col("_mid").alias("b"), F.col("_clo").alias("c"), F.col("_cmid").alias("d")), F.struct(F.col("_mid").alias("a"), F.col("_hi").alias("b"), F.col("_cmid").alias("c"), F.col("_chi").alias("d"))))
        cut = middle.withColumn("_half", half)
        front = cut.select(*keys, *(f"_{i}" for i in range(4)), "_move", *(F.col(f"_half.{x}").alias(n) for x, n in zip("abcd", ("_lo", "_hi", "_clo", "_chi"), strict=True)))
    upto = F.when(F.col("_clo") <= 0, F.col("_lo")).otherwise(F.col("_hi"))
    hit = F.col("_touched") | F.col("_left")
    first = F.min(F.when(hit, F.struct(upto.alias("upto"), F.col("_lo").alias("after"), F.col("_touched").alias("sure"))))
    found = seen.groupBy(*keys).agg(first.alias("_first"), F.min("_least").alias("least"))
    return found.select(*keys, F.col("_first").isNotNull().alias("contact"), F.col("_first.sure").alias("sure"), F.col("_first.after").alias("after"), F.col("_first.upto").alias("upto"), "least")
