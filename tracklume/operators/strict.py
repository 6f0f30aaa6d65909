"""Strict joins and selections: what is missing, repeated or not allowed is counted or stops the job, and never vanishes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _once(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """``rows`` as one struct a key, with how many there are."""
    rest = F.struct(*(c for c in rows.columns if c not in keys))
    return rows.groupBy(*keys).agg(F.count("*").alias(f"_n_{name}"), F.first(rest).alias(name))


def complete_join(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Tables by name as one row a key: keys, a struct of each table's other columns, and ``state``.

    ``complete``, or ``missing:`` and ``repeated:`` with the names of tables
    that have no row, or several, of the key; of several one is kept.  Null
    keys meet each other.
    """
    told = [_once(t, name, keys).withColumnsRenamed({k: f"_{name}_{k}" for k in keys}) for name, t in tables.items()]
    names = list(tables)
    out = told[0].withColumnsRenamed({f"_{names[0]}_{k}": k for k in keys})
    for name, right in zip(names[1:], told[1:], strict=True):
        same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{name}_{k}")) for k in keys))
        here = F.col(f"_n_{name}").isNotNull()
        met = out.withColumn("_here", F.lit(True)).join(right, same, "full_outer")
        out = met.withColumns({k: F.when(here & F.col("_here").isNull(), F.col(f"_{name}_{k}")).otherwise(F.col(k)) for k in keys}).drop("_here", *(f"_{name}_{k}" for k in keys))
    some = lambda test: F.array_compact(F.array(*(F.when(test(F.col(f"_n_{n}")), F.lit(n)) for n in names)))
    missing, repeated = some(lambda c: c.isNull()), some(lambda c: c > 1)
    state = F.concat_ws(" ", F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))), F.when(F.size(repeated) > 0, F.concat(F.lit("repeated:"), F.array_join(repeated, ","))))
    return out.select(*keys, *names, F.when(state == "", "complete").otherwise(state).alias("state"))


def require_complete(joined: DataFrame, keys: list[str]) -> DataFrame:
    """The complete rows without ``state``; one that isn't stops the job, with its keys and state in the message."""
    message = F.concat(F.to_json(F.struct(*keys)), F.lit(" is "), F.col("state"))
    checked = F.when(F.col("state") == "complete", F.col("state")).otherwise(F.raise_error(message))
    return joined.withColumn("state", checked).where("state = 'complete'").drop("state")


def revalued(facts: DataFrame, records: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """``facts`` with the ``labels`` that ``records`` (unique keys) have for them: adds ``revalued`` and ``was``, the labels that changed with what they were."""
    told = records.select(*keys, *(F.col(c).alias(f"_{c}") for c in labels)).withColumn("_there", F.lit(True))
    met = facts.join(told, keys, "left")
    there = F.col("_there").isNotNull()
    changed = F.array_compact(F.array(*(F.when(there & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null")))) for c in labels)))
    new = {c: F.when(there, F.col(f"_{c}")).otherwise(F.col(c)) for c in labels}
    return met.withColumns({"revalued": there, "was": changed}).withColumns(new).drop("_there", *(f"_{c}" for c in labels))


def allowed(rows: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns, in this order; one that isn't there is an error."""
    if absent := [c for c in names if c not in rows.columns]:
        raise ValueError(f"no column {', '.join(absent)}")
    return rows.select(*names)


#: Fields of a footprint's variants.
FOOTPRINTS = {"circle": ("radius_m",), "rectangle": ("length_m", "width_m")}


def footprint_json(kind: Column, fields: dict[str, Column]) -> Column:
    """Canonical JSON of a footprint: its kind and that kind's fields, keys in order; null for an unknown kind or a size that isn't positive and finite."""
    out = F.lit(None).cast("string")
    for name, own in FOOTPRINTS.items():
        good = reduce(Column.__and__, (fields[f].isNotNull() & (fields[f] > 0) & (fields[f] < float("inf")) for f in own))
        told = F.to_json(F.struct(*(F.lit(name).alias("kind") if f == "kind" else fields[f].alias(f) for f in sorted(("kind", *own)))))
        out = F.when((kind == name) & good, told).otherwise(out)
    return out


def footprint_struct(text: Column) -> Column:
    """A footprint's JSON as (kind, radius_m, length_m, width_m), fields of other kinds null; null if it isn't one: unknown kinds, fields missing, too many, or not positive."""
    every = [f for own in FOOTPRINTS.values() for f in own]
    told = F.from_json(text, "kind string, " + ", ".join(f"{f} double" for f in every))
    keys = F.sort_array(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")))
    good = F.lit(False)
    for name, own in FOOTPRINTS.items():
        sizes = reduce(Column.__and__, (told[f].isNotNull() & (told[f] > 0) & (told[f] < float("inf")) for f in own))
        good = good | ((told["kind"] == name) & sizes & (keys == F.array(*(F.lit(f) for f in sorted(("kind", *own))))))
    return F.when(F.coalesce(good, F.lit(False)), told)


def slice_key(provenance: Column, path: str) -> Column:
    """A value of nested JSON provenance by its path (``$.a.b``); ``unavailable`` where it isn't there or null."""
    return F.coalesce(F.get_json_object(provenance, path), F.lit("unavailable"))
