"""All queries of the library outside llm, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyrine.plans import claim_queries, contact_queries, entry_queries, finding_queries, grading_queries, grounding_queries, impression_queries, norm_queries, page_queries, posting_queries, report_queries, requirement_queries, retrieval_queries, rewrite_queries, role_queries, source_queries, table_queries, text_queries, timeline_queries, wording_queries

_PARTS = (text_queries, retrieval_queries, grading_queries, table_queries, report_queries, rewrite_queries, timeline_queries, grounding_queries, wording_queries, contact_queries, finding_queries, entry_queries, page_queries, role_queries, norm_queries, source_queries, claim_queries, posting_queries, requirement_queries, impression_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
