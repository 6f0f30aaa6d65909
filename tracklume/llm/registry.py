"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tracklume.llm import alignment_query, conversations_query, decontamination_query, html_text_query, jaccard_join_query, media_query, packing_query, sharding_query, substring_dedup_query, token_files_query, toxicity_query, url_filter_query, warc_query

MODULES = (substring_dedup_query, toxicity_query, decontamination_query, sharding_query, jaccard_join_query, packing_query, url_filter_query, html_text_query, media_query, warc_query, alignment_query, conversations_query, token_files_query)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
