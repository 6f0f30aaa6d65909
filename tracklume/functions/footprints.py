"""Footprints as column expressions: a rectangle (length, width) grown by a radius; a circle is one of no length and width.

A ``Shape`` is seven columns.  Clearances are JVM expressions of them: no shape
passes through Python.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklume.functions.geometry import distance
from tracklume.operators.tracks import wrap_angle

_EPS = 2.0**-52


@dataclass(frozen=True)
class Shape:
    """A pose and a footprint."""

    x: Column
    y: Column
    yaw: Column
    length: Column
    width: Column
    radius: Column
    turn: tuple[Column, Column] | None = None

    def turned(self) -> tuple[Column, Column]:
        """Cosine and sine of the yaw: ``turn`` where it is known."""
        return self.turn or (F.cos(self.yaw), F.sin(self.yaw))

    @staticmethod
    def named(prefix: str, length: Column | float, width: Column | float, radius: Column | float) -> Shape:
        """The shape whose pose is in the columns ``prefix`` x, y and yaw."""
        put = lambda v: v if isinstance(v, Column) else F.lit(float(v))
        return Shape(F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}yaw"), put(length), put(width), put(radius))

    def inflated(self, margin: Column | float) -> Shape:
        """Circles grow by ``margin`` in radius, rectangles by twice as much in length and width."""
        m, round_ = F.lit(margin) if not isinstance(margin, Column) else margin, (self.length == 0) & (self.width == 0)
        grown = F.when(round_, 0.0).otherwise(2 * m)
        return replace(self, length=self.length + grown, width=self.width + grown, radius=self.radius + F.when(round_, m).otherwise(0.0))

    def reach(self) -> Column:
        """How far any point of the footprint is from its centre."""
        return F.hypot(self.length, self.width) / 2 + self.radius

    def box(self) -> tuple[Column, Column, Column, Column]:
        """x0, x1, y0, y1 of the least upright box."""
        c, s = F.abs(F.cos(self.yaw)), F.abs(F.sin(self.yaw))
        hx, hy = (self.length * c + self.width * s) / 2 + self.radius, (self.length * s + self.width * c) / 2 + self.radius
        return self.x - hx, self.x + hx, self.y - hy, self.y + hy

    def corners(self) -> list[tuple[Column, Column]]:
        """The rectangle's corners, counter-clockwise."""
        (c, s), out = self.turned(), []
        for i, j in ((1, 1), (-1, 1), (-1, -1), (1, -1)):
            dx, dy = i * self.length / 2, j * self.width / 2
            out.append((self.x + dx * c - dy * s, self.y + dx * s + dy * c))
        return out

    def between(self, other: Shape, share: Column) -> Shape:
        """This footprint on the way to the pose of ``other``: straight, and turning the shorter way."""
        turn = wrap_angle(other.yaw - self.yaw)
        return replace(self, x=self.x + share * (other.x - self.x), y=self.y + share * (other.y - self.y), yaw=wrap_angle(self.yaw + share * turn))

    def motion(self, other: Shape) -> Column:
        """No point of the footprint moves further on that way."""
        return F.hypot(other.x - self.x, other.y - self.y) + (F.hypot(self.length, self.width) / 2) * F.abs(wrap_angle(other.yaw - self.yaw))


def _local(px: Column, py: Column, of: Shape) -> tuple[Column, Column]:
    """A point in the frame of a footprint."""
    (c, s), dx, dy = of.turned(), px - of.x, py - of.y
    return dx * c + dy * s, dy * c - dx * s


def _outside(px: Column, py: Column, of: Shape) -> Column:
    """How far a point is from a rectangle; 0 inside."""
    lx, ly = _local(px, py, of)
    qx, qy = F.greatest(F.abs(lx) - of.length / 2, F.lit(0.0)), F.greatest(F.abs(ly) - of.width / 2, F.lit(0.0))
    return distance(qx, qy)


def _gaps(a: Shape, b: Shape, c: Column, s: Column) -> list[Column]:
    """Along the two axes of ``a``: the centres' distance less what both rectangles reach, 0 within rounding."""
    lx, ly = _local(b.x, b.y, a)
    out = []
    for at, own, reach in ((lx, a.length, b.length * c + b.width * s), (ly, a.width, b.length * s + b.width * c)):
        apart, sum_ = F.abs(at), (own + reach) / 2
        gap = apart - sum_
        out.append(F.when(F.abs(gap) <= 8 * _EPS * F.greatest(apart, sum_), 0.0).otherwise(gap))
    return out


def clearance(a: Shape, b: Shape) -> Column:
    """Signed distance of two footprints: touching is 0, inside each other it is less by the least way out.

    Rectangles that no axis of theirs separates overlap by the axis of the
    largest gap; others are as far apart as the nearest corner of either from
    the other.  Radii are taken off.
    """
    c, s = F.abs(F.cos(b.yaw - a.yaw)), F.abs(F.sin(b.yaw - a.yaw))
    widest = F.greatest(*_gaps(a, b, c, s), *_gaps(b, a, c, s))
    nearest = F.least(*(_outside(x, y, b) for x, y in a.corners()), *(_outside(x, y, a) for x, y in b.corners()))
    return F.when(widest > 0, nearest).otherwise(widest) - a.radius - b.radius


def with_clearance(rows: DataFrame, a: Shape, b: Shape, name: str) -> DataFrame:
    """``rows`` with their ``clearance`` in steps of columns: corners, distances, choice.  None is worked out twice, as they are in one expression."""
    points = [(*p, of) for shape, of in ((a, b), (b, a)) for p in shape.corners()]
    first = {"_cos": F.abs(F.cos(b.yaw - a.yaw)), "_sin": F.abs(F.sin(b.yaw - a.yaw)), **{f"_{c}{i}": v for i, (x, y, _) in enumerate(points) for c, v in (("x", x), ("y", y))}}
    c, s = F.col("_cos"), F.col("_sin")
    gaps = {f"_gap{i}": v for i, v in enumerate([*_gaps(a, b, c, s), *_gaps(b, a, c, s)])}
    away = {f"_away{i}": _outside(F.col(f"_x{i}"), F.col(f"_y{i}"), of) for i, (_, _, of) in enumerate(points)}
    found = rows.withColumns(first).withColumns({**gaps, **away}).withColumn("_widest", F.greatest(*gaps))
    return found.withColumn(name, F.when(F.col("_widest") > 0, F.least(*away)).otherwise(F.col("_widest")) - a.radius - b.radius).drop(*first, *gaps, *away, "_widest")
