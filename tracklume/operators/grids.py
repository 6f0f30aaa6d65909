"""Sparse grids: a row a cell.  Rasters, visibility, last-seen state, forecasts and scores over cell sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklume.functions import geometry_numpy as G
from tracklume.functions.geometry import grid_cell


def cells(points: DataFrame, x: str, y: str, resolution: float, height: int, width: int) -> DataFrame:
    """``points`` inside the grid with ``row`` and ``col``."""
    row, column, inside = grid_cell(F.col(x), F.col(y), resolution, height, width)
    return points.where(inside).withColumns({"row": row, "col": column})


def disc_cells(points: DataFrame, keys: list[str], x: str, y: str, radius: float, resolution: float, height: int, width: int) -> DataFrame:
    """keys, row, col of every cell whose closed square a disc touches, by cell arithmetic alone."""
    reach = int(radius / resolution) + 1
    row, column, _ = grid_cell(F.col(x), F.col(y), resolution, height, width)
    span = F.sequence(F.lit(-reach), F.lit(reach))
    near = points.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), row.alias("_r"), column.alias("_c"))
    near = near.select(*keys, "_x", "_y", "_c", F.explode(F.transform(span, lambda d: F.col("_r") + d)).alias("row"))
    near = near.select(*keys, "_x", "_y", "row", F.explode(F.transform(span, lambda d: F.col("_c") + d)).alias("col"))
    half = resolution / 2
    dx = F.greatest(F.abs(F.col("_x") - (F.col("col") + 0.5 - width / 2) * resolution) - half, F.lit(0.0))
    dy = F.greatest(F.abs(F.col("_y") - (F.col("row") + 0.5 - height / 2) * resolution) - half, F.lit(0.0))
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    return near.where(inside & (dx * dx + dy * dy <= radius * radius + 1e-12)).select(*keys, "row", "col")


def visibility(blocked: DataFrame, key: str, sensor_row: int, sensor_col: int, height: int, width: int) -> DataFrame:
    """key, row, col of the cells that a sensor sees, for each key's set of blocked cells (row, col)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((height, width), bool)
        grid[frame["row"], frame["col"]] = True
        r, c = np.nonzero(G.visible(grid, sensor_row, sensor_col))
        return pd.DataFrame({key: [frame[key].iloc[0]] * len(r), "row": r.astype("int32"), "col": c.astype("int32")})

    kind = blocked.schema[key].dataType.simpleString()
    # A grid bounds the group: height x width cells at most, once they are distinct.
    return blocked.select(key, "row", "col").distinct().groupBy(key).applyInPandas(run, f"`{key}` {kind}, row int, col int")


def last_seen(seen: DataFrame, keys: list[str], step: str, occupied: str, now: int, dt: float, most: float) -> DataFrame:
    """Per cell the occupancy at its latest visible step, and its age min((now - step) dt / most, 1)."""
    found = seen.groupBy(*keys).agg(F.max_by(occupied, step).alias("last_seen"), F.max(step).alias("_s"))
    return found.select(*keys, "last_seen", F.least((F.lit(now) - F.col("_s")) * dt / most, F.lit(1.0)).alias("age"))


def age_decay(state: DataFrame, steps: int, dt: float, most: float, tau: float) -> DataFrame:
    """Forecast per future step k: last_seen exp(-(age most + t) / tau), t = (k + 1) dt; cells last seen empty give nothing."""
    t = (F.col("k") + 1) * dt
    return state.where("last_seen > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("p", F.col("last_seen") * F.exp(-(F.col("age") * most + t) / tau))


def swept_risk(forecast: DataFrame, keys: list[str], p: str) -> DataFrame:
    """1 - prod(1 - p) over the cells of each key, in logarithms; certain cells give 1."""
    sure = F.max(F.when(F.col(p) >= 1, 1).otherwise(0))
    return forecast.groupBy(*keys).agg(F.when(sure == 1, 1.0).otherwise(1 - F.exp(F.sum(F.log1p(-F.least(F.col(p), F.lit(1 - 1e-15)))))).alias("risk"))


def discounted_risk(forecast: DataFrame, keys: list[str], p: str, step: str, dt: float, sigma: float) -> DataFrame:
    """The mean of ``p`` over the cells and steps of each key, weighted by exp(-(step + 1) dt / sigma); keys without cells have no row."""
    weight = F.exp(-(F.col(step) + 1) * dt / sigma)
    return forecast.groupBy(*keys).agg((F.sum(weight * F.col(p)) / F.sum(weight)).alias("risk"))


def binary_entropy(p: Column) -> Column:
    inner = -(p * F.log(p) + (1 - p) * F.log(1 - p))
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(inner)


def first_arrival(path: DataFrame, keys: list[str], t: str, v: str, a_max: float) -> DataFrame:
    """Per key and cell of a path: first time, and the braking margin there: distance travelled less v^2 / 2a."""
    order = Window.partitionBy(*keys).orderBy(t)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)), F.lit(0.0))
    far = path.withColumn("_d", step).withColumn("_far", F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = far.groupBy(*keys, "row", "col").agg(F.min(t).alias("first"), F.min_by(F.col("_far") - F.col(v) ** 2 / (2 * a_max), t).alias("margin"))
    return found
