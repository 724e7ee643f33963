"""All registered queries over the core operators with their SQL."""

from __future__ import annotations

from corpusloom.plans import corpus_pipeline, corpus_queries, library_queries, operations_queries, relational_queries, retrieval_queries, star_queries, stream_queries, text_queries  # noqa: F401
from corpusloom.plans.registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
