"""Inversions of many groups at once, by levels of range partitions: no pair of rows is ever formed.

A large group is cut into ranges of x and into ranges of y.  Pairs of rows that
differ in both ranges are counted from the numbers of rows in the cells of the
grid; pairs of one x range are the same problem over fewer rows, and so are
pairs of one y range in different x ranges, with the range for x.  Groups of at
most LEFT rows are counted inside tasks by sorting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklume.sources.shared_tables import SharedTables

LEFT = 50_000
CUTS, ACCURACY = 64, 10_000


def weighted_inversions(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """The sum of w_i * w_j over all pairs of x_i < x_j and y_i > y_j.

    In the order of x (equal ones by y), rows that agree in all bits of y's
    rank above one, and differ in it, are counted bit by bit by running sums.
    """
    order = np.lexsort((y, x))
    rank, w = np.unique(y[order], return_inverse=True)[1].reshape(-1), w[order].astype(object if float(w.sum()) ** 2 > 2**62 else np.int64)
    total = 0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        above = rank >> (bit + 1)
        by = np.argsort(above, kind="stable")
        high, group, weight = (rank[by] >> bit) & 1, above[by], w[by]
        seen = np.cumsum(weight * high)
        first = np.r_[True, group[1:] != group[:-1]]
        before = np.repeat((seen - weight * high)[first], np.diff(np.r_[np.flatnonzero(first), len(group)]))
        total += int(((seen - before) * weight * (1 - high)).sum())
    return total


def _in_task(table: pa.Table) -> pa.Table:
    x, y, w = (table[c].to_numpy() for c in ("x", "y", "w"))
    return pa.table({"g": table["g"][:1], "value": pa.array([float(weighted_inversions(x, y, w))])})


def _between_cells(table: pa.Table) -> pa.Table:
    """Of a group's cells (p, r, w): pairs of rows in different ranges of both, in the wrong order."""
    grid = np.zeros((2 * CUTS + 3, 2 * CUTS + 3))
    grid[table["p"].to_numpy(), table["r"].to_numpy()] = table["w"].to_numpy()
    # Rows of later ranges of x and earlier ranges of y.
    later = grid[::-1].cumsum(0)[::-1][1:]
    earlier = np.c_[np.zeros(len(later)), later.cumsum(1)[:, :-1]]
    return pa.table({"g": table["g"][:1], "value": pa.array([float((grid[:-1] * earlier).sum())])})


def _range(value: str, cuts: str) -> Column:
    """The range of a value between sorted cuts; a value that is a cut has a range of its own, so that a frequent one stands alone."""
    under = F.size(F.filter(cuts, lambda c: c < F.col(value)))
    return (2 * under + F.array_contains(cuts, F.col(value)).cast("int")).cast("int")


def inversions(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """``group`` and ``inversions`` (double): how many pairs of its rows have x_i < x_j and y_i > y_j.

    Rows with a null x or y are in no pair; a null group is one; a group
    without pairs has 0.  Equal rows are one, with their number.
    """
    tables = SharedTables(rows.sparkSession, "inversions")
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    told = known.groupBy(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("w"))
    told = told.select(F.struct(F.col("g")).alias("g0"), F.to_json(F.struct("g"), {"ignoreNullFields": "false"}).alias("g"), "x", "y", "w")
    start = tables.write(told, "rows")
    names = start.groupBy("g").agg(F.first("g0.g").alias("_name"))
    parts, level = [], 0
    now = start.select("g", "x", "y", "w", F.col("g").alias("of"))
    while True:
        bounds = now.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where("x0 < x1 and y0 < y1").select("g", "n")
        sized = tables.write(now.join(bounds, "g"), f"level-{level}")
        owner = sized.select("g", "of").distinct()
        few = sized.where(F.col("n") <= LEFT).groupBy("g").applyInArrow(_in_task, "g string, value double")
        parts.append(few.join(owner, "g").select("of", "value"))
        many = sized.where(F.col("n") > LEFT)
        if many.isEmpty():
            break
        shares = [i / CUTS for i in range(1, CUTS)]
        cuts = many.groupBy("g").agg(F.array_distinct(F.percentile_approx("x", shares, ACCURACY)).alias("cx"), F.array_distinct(F.percentile_approx("y", shares, ACCURACY)).alias("cy"))
        placed = tables.write(many.join(cuts, "g").select("g", "of", "x", "y", "w", _range("x", "cx").alias("p"), _range("y", "cy").alias("r")), f"placed-{level}")
        cells = placed.groupBy("g", "p", "r").agg(F.sum("w").alias("w")).groupBy("g").applyInArrow(_between_cells, "g string, value double")
        parts.append(cells.join(owner, "g").select("of", "value"))
        in_x = placed.select(F.concat_ws("/x", "g", "p").alias("g"), "x", "y", "w", "of")
        in_y = placed.groupBy(F.concat_ws("/y", "g", "r").alias("g"), F.col("p").cast("double").alias("x"), "y", "of").agg(F.sum("w").alias("w")).select("g", "x", "y", "w", "of")
        now, level = in_x.unionByName(in_y), level + 1
    values = parts[0]
    for more in parts[1:]:
        values = values.unionByName(more)
    sums = values.groupBy(F.col("of").alias("g")).agg(F.sum("value").alias("value"))
    return names.join(sums, "g", "left").select(F.col("_name").alias(group), F.coalesce("value", F.lit(0.0)).alias("inversions"))


def kendall(rows: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """group, concordant, discordant, tied_a, tied_b (pairs tied in that one alone) and tau_b, 0 where it is degenerate; rows with a null don't count."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(group).alias("g"), F.col(a).alias("a"), F.col(b).alias("b"))
    joint = known.groupBy("g", "a", "b").agg(F.count("*").alias("c"))
    two = lambda c: F.sum(c * (c - 1) / 2)
    both = joint.groupBy("g").agg(two(F.col("c")).alias("ab"), F.sum("c").alias("n"))
    ties = [joint.groupBy("g", x).agg(F.sum("c").alias("c")).groupBy("g").agg(two(F.col("c")).alias(x)) for x in ("a", "b")]
    found = inversions(known, "g", "a", "b")
    met = found.withColumnRenamed("inversions", "d")
    for more in (both, *ties):
        more = more.withColumnRenamed("g", "_h")
        met = met.join(more, F.col("g").eqNullSafe(F.col("_h"))).drop("_h")
    concordant = F.col("n") * (F.col("n") - 1) / 2 - F.col("a") - F.col("b") + F.col("ab") - F.col("d")
    counted = met.select("g", concordant.alias("c"), "d", (F.col("a") - F.col("ab")).alias("ta"), (F.col("b") - F.col("ab")).alias("tb"))
    scale = F.sqrt((F.col("c") + F.col("d") + F.col("ta")) * (F.col("c") + F.col("d") + F.col("tb")))
    tau = F.when(scale > 0, (F.col("c") - F.col("d")) / scale).otherwise(0.0)
    return counted.select(F.col("g").alias(group), *(F.col(x).cast("long").alias(y) for x, y in (("c", "concordant"), ("d", "discordant"), ("ta", "tied_a"), ("tb", "tied_b"))), F.round(tau, 9).alias("tau_b"))
