"""Scenario rows: footprints, action fan-out, context maps and edits, schedules, keyed draws, zipped cohorts and sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (name, seconds, metres forward, degrees turned) of the six actions, and weights of seconds, metres and degrees.
ACTIONS = (("wait", 1.0, 0.0, 0.0), ("creep", 1.0, 0.25, 0.0), ("advance", 1.5, 0.75, 0.0), ("turn_left", 1.0, 0.0, 30.0), ("turn_right", 1.0, 0.0, -30.0), ("retreat", 1.5, -0.5, 0.0))
WEIGHTS = (0.5, 1.0, 0.02)


def footprints(frames: DataFrame, key: str, fixed: Column, least: int = 20, shortest: float = 0.2, longest: float = 4.5) -> DataFrame:
    """key, shape, radius, length, width from frames (key, valid, length, width).

    A circle where ``fixed`` (over key columns carried as ``fixed``) says so; a
    rectangle of clipped 0.95 quantiles where at least ``least`` frames are
    valid; else a circle by default.
    """
    quantile = lambda c: F.percentile(F.when(F.col("valid"), F.col(c)), 0.95)
    clip = lambda c: F.greatest(F.least(c, F.lit(longest)), F.lit(shortest))
    found = frames.groupBy(key).agg(F.max(fixed).alias("_fixed"), F.sum(F.when(F.col("valid"), 1).otherwise(0)).alias("_n"), quantile("length").alias("_l"), quantile("width").alias("_w"))
    measured = ~F.col("_fixed") & (F.col("_n") >= least)
    radius = F.when(F.col("_fixed"), 0.35).when(~measured, 0.5)
    return found.select(key, F.when(measured, "rectangle").otherwise("circle").alias("shape"), radius.alias("radius"), F.when(measured, clip(F.col("_l"))).alias("length"), F.when(measured, clip(F.col("_w"))).alias("width"))


def action_cost(seconds: float, metres: float, degrees: float) -> float:
    return WEIGHTS[0] * seconds + WEIGHTS[1] * abs(metres) + WEIGHTS[2] * abs(degrees)


def fan_out(rows: DataFrame, budget: Column) -> DataFrame:
    """A row for each of the six actions of every row: action, cost, feasible (cost within ``budget``) and complete (all six are)."""
    options = F.array(*(F.struct(F.lit(name).alias("action"), F.lit(action_cost(*x)).alias("cost")) for name, *x in ACTIONS))
    most = max(action_cost(*x) for _, *x in ACTIONS)
    fanned = rows.withColumns({"_budget": budget, "_option": F.explode(options)})
    feasible = F.coalesce(F.col("_option.cost") <= F.col("_budget"), F.lit(False))
    complete = F.coalesce(F.col("_budget") >= most, F.lit(False))
    return fanned.select(*rows.columns, "_option.action", "_option.cost", feasible.alias("feasible"), complete.alias("complete"))


def with_context(records: DataFrame, world: DataFrame, key: str, context: str, entry: str) -> DataFrame:
    """Records with the ``context`` map of their world (N:1) joined with the record's own ``entry`` map; a name in both fails, a record without a world goes."""
    return records.join(world.select(key, F.col(context).alias("_context")), key).withColumn(context, F.map_concat("_context", entry)).drop("_context", entry)


def edited(rows: DataFrame, column: str, edits: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """A row for each edit (name -> (entry, its new value, or None to drop it)): variant, the edited map and ``changed``, the entries that differ."""
    state = F.col(column)

    def apply(entry: str, value: Column | None) -> Column:
        if value is None:
            return F.map_filter(state, lambda k, _: k != entry)
        return F.transform_values(state, lambda k, v: F.when(k == entry, value).otherwise(v))

    options = F.array(*(F.struct(F.lit(n).alias("variant"), apply(*e).alias("after")) for n, e in edits.items()))
    keys = F.array_sort(F.map_keys(state))
    told = rows.withColumn("_edit", F.explode(options))
    changed = F.filter(keys, lambda k: ~state[k].eqNullSafe(F.col("_edit.after")[k]))
    return told.select(*rows.columns, "_edit.variant", "_edit.after", changed.alias("changed"))


def overlaps(objects: DataFrame, track: DataFrame, key: str, clearance: Column) -> DataFrame:
    """Objects with ``missing`` (no track row) and ``overlap``: whether any clearance is at most 0, or the track is missing."""
    met = track.groupBy(key).agg(F.max(F.coalesce(clearance <= 0, F.lit(False))).alias("_met"))
    return objects.join(met, key, "left").withColumns({"missing": F.col("_met").isNull(), "overlap": F.coalesce("_met", F.lit(True))}).drop("_met")


def schedule(options: DataFrame, group: str, side: str, kind: str) -> DataFrame:
    """Every (side, kind) of a group once, sides in turn: rank is the kind's place in the side's own permutation, by MD5; slot the place in the group."""
    seed = F.md5(F.concat_ws("|", F.col(group).cast("string"), side, kind))
    ranked = options.withColumn("rank", F.row_number().over(Window.partitionBy(group, side).orderBy(seed, kind)))
    return ranked.withColumn("slot", F.row_number().over(Window.partitionBy(group).orderBy("rank", side)))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1] that the parts decide: the first 32 bits of their MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") + 1) / (1 << 32)


def truncated_normal(key: Column, attempt: Column, sigma: float, bound: float) -> Column:
    """A normal draw of a key's attempt, null where it falls outside [-bound, bound]: the attempt is used up."""
    draw = F.sqrt(-2 * F.log(uniform(key, attempt, F.lit("r")))) * F.cos(2 * F.pi() * uniform(key, attempt, F.lit("a"))) * sigma
    return F.when(F.abs(draw) <= bound, draw)


def zipped(cohort: DataFrame, vector: DataFrame, group: str, cohort_order: list[Column], vector_order: list[Column]) -> DataFrame:
    """Rows of equal place in a group's two orders, side by side; ``matched`` is false where one side is shorter."""
    place = lambda rows, by: rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*by)))
    left, right = place(cohort, cohort_order).withColumn("_l", F.lit(True)), place(vector, vector_order).withColumn("_r", F.lit(True))
    return left.join(right, [group, "position"], "full").withColumn("matched", F.col("_l").isNotNull() & F.col("_r").isNotNull()).drop("_l", "_r")


def sensitivity(base: Column, changed: Column) -> list[Column]:
    """How far two predictions of the same rows lie apart: rows, mean and greatest distance."""
    apart = F.abs(base - changed)
    return [F.count("*").alias("n"), F.round(F.avg(apart), 9).alias("mean_abs"), F.round(F.max(apart), 9).alias("max_abs")]


def stamped(rows: DataFrame, **provenance: str) -> DataFrame:
    """Rows with ``provenance``: a struct of constants, names in order."""
    return rows.withColumn("provenance", F.struct(*(F.lit(v).alias(k) for k, v in sorted(provenance.items()))))
