"""Planar geometry as column expressions: rigid transforms, footprints, clearances, grids and unicycle motion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_local(x: Column, y: Column, px: Column, py: Column, yaw: Column) -> tuple[Column, Column]:
    """A global point in the frame of a pose."""
    dx, dy = x - px, y - py
    return dx * F.cos(yaw) + dy * F.sin(yaw), dy * F.cos(yaw) - dx * F.sin(yaw)


def to_global(x: Column, y: Column, px: Column, py: Column, yaw: Column) -> tuple[Column, Column]:
    return px + x * F.cos(yaw) - y * F.sin(yaw), py + x * F.sin(yaw) + y * F.cos(yaw)


def distance(dx: Column, dy: Column) -> Column:
    """The root of the sum of squares as SQL has it: ``hypot`` may differ in the last bit, which tells at a limit."""
    return F.sqrt(dx * dx + dy * dy)


def circle_circle(ax: Column, ay: Column, ar: Column, bx: Column, by: Column, br: Column) -> Column:
    """Signed clearance: distance less both radii; touching is 0."""
    return distance(ax - bx, ay - by) - (ar + br)


def circle_rectangle(cx: Column, cy: Column, r: Column, px: Column, py: Column, yaw: Column, length: Column, width: Column) -> Column:
    """Signed distance of the circle's centre from the rectangle, less the radius."""
    lx, ly = to_local(cx, cy, px, py, yaw)
    qx, qy = F.abs(lx) - length / 2, F.abs(ly) - width / 2
    outside = distance(F.greatest(qx, F.lit(0.0)), F.greatest(qy, F.lit(0.0)))
    return outside + F.least(F.greatest(qx, qy), F.lit(0.0)) - r


def segment_hits_circle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, r: Column, eps: float = 1e-9) -> Column:
    """Whether the closed segment comes within r of the centre."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    u = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((cx - ax) * dx + (cy - ay) * dy) / square))).otherwise(0.0)
    return F.hypot(cx - ax - u * dx, cy - ay - u * dy) <= r + eps


def grid_cell(x: Column, y: Column, resolution: float, height: int, width: int) -> tuple[Column, Column, Column]:
    """(row, column, inside) on a centred half-open grid; rows follow y."""
    row = F.floor(y / resolution + height / 2).cast("int")
    column = F.floor(x / resolution + width / 2).cast("int")
    return row, column, (row >= 0) & (row < height) & (column >= 0) & (column < width)


def unicycle(v: Column, omega: Column, t: Column) -> tuple[Column, Column, Column]:
    """Closed form from the origin; straight where the turn rate is all but 0."""
    straight = F.abs(omega) < 1e-9
    turn = F.when(straight, F.lit(1.0)).otherwise(omega)
    return (
        F.when(straight, v * t).otherwise(v / turn * F.sin(omega * t)),
        F.when(straight, F.lit(0.0)).otherwise(v / turn * (1 - F.cos(omega * t))),
        omega * t,
    )


def severity(clearance: Column, t: Column, sigma_d: float = 0.5, sigma_t: float = 2.0) -> Column:
    """Discounted closeness; 1 on contact."""
    return F.when(clearance <= 0, 1.0).otherwise(F.exp(-clearance / sigma_d) * F.exp(-t / sigma_t))
