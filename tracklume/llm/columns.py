"""A table's own columns under names that no step of an operator uses."""

from __future__ import annotations

from pyspark.sql import DataFrame


def aside(rows: DataFrame, *replaced: str) -> tuple[DataFrame, dict[str, str]]:
    """``rows`` without the columns ``replaced``, the others named by their places; from each column's name to the one it has now."""
    kept = rows.drop(*replaced)
    return kept.toDF(*(f"own_{i}" for i in range(len(kept.columns)))), {x: f"own_{i}" for i, x in enumerate(kept.columns)}
