"""The queries over the driver tables, and the DuckDB SQL each is held against.

Each module under ``tracklume.plans`` that declares queries has a dict
``QUERIES`` (name -> callable) and a dict ``ORACLE`` (name -> SQL).
"""

from __future__ import annotations

from tracklume.plans import base_state_queries, cohort_queries, contact_queries, contract_queries, data_queries, decision_queries, geometry_queries, metric_queries, publication_queries, scenario_queries, sealed_queries, stream_queries, track_queries

MODULES = (track_queries, base_state_queries, metric_queries, decision_queries, geometry_queries, contact_queries, contract_queries, data_queries, cohort_queries, scenario_queries, sealed_queries, publication_queries, stream_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
