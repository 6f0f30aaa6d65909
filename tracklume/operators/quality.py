"""Row contracts, ordered reject reasons, funnels and schema guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

# Words that must not stand in the field names of observable tables.
FORBIDDEN = ("oracle", "future", "world", "ground_truth", "hidden", "label")


def reject_reasons(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``reasons``, the codes of all checks that hit, in their order, and ``accepted``: none hit.  A null check doesn't hit."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks)))
    return rows.withColumn("reasons", found).withColumn("accepted", F.size("reasons") == 0)


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The first check that hits, or null."""
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in checks))


def funnel(judged: DataFrame, source: str) -> DataFrame:
    """outcome, n, sources: accepted rows, and rejected ones by each of their reasons."""
    each = judged.select(source, F.explode(F.when(F.col("accepted"), F.array(F.lit("accepted"))).otherwise(F.col("reasons"))).alias("outcome"))
    return each.groupBy("outcome").agg(F.count("*").alias("n"), F.countDistinct(source).alias("sources"))


def violations(rows: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """key and rule of every row contract that is broken; a null condition is broken too."""
    marked = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules)))
    return rows.select(key, F.explode(marked).alias("rule"))


def forbidden_fields(schema: S.StructType, words: tuple[str, ...] = FORBIDDEN) -> list[str]:
    """Dotted names of fields, nested ones too, that hold a forbidden word."""
    found = []

    def walk(kind: S.DataType, name: str) -> None:
        if isinstance(kind, S.StructType):
            for f in kind.fields:
                path = f"{name}.{f.name}".strip(".")
                if any(w in f.name.lower() for w in words):
                    found.append(path)
                walk(f.dataType, path)
        elif isinstance(kind, S.ArrayType):
            walk(kind.elementType, name)
        elif isinstance(kind, S.MapType):
            walk(kind.valueType, name)

    walk(schema, "")
    return found


def taxonomy(name: Column) -> Column:
    """human for helmets and visitors, carried_object for load numbers and containers, else unknown_dynamic."""
    low = F.lower(name)
    return F.when(low.rlike(r"^helmet_|visitor"), "human").when(low.rlike(r"^lo(\d+|\b)|cart|\bbin|box|bucket|carried"), "carried_object").otherwise("unknown_dynamic")


def parse_number(text: Column) -> Column:
    """Double, or null for empty, N/A, NA, NAN and what can't be read."""
    clean = F.upper(F.trim(text))
    return F.when(~clean.isin("", "N/A", "NA", "NAN"), clean.try_cast("double"))
