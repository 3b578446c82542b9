"""Queries that compose the operators over the tables."""

from __future__ import annotations


def _load() -> None:
    from lodestrand.plans import corpus_queries, evaluation_queries, grading_queries, more_queries, pipeline_queries, report_queries, retrieval_queries, state_queries, text_queries  # noqa: F401


def core_queries() -> dict:
    from lodestrand.plans import registry

    _load()
    return dict(registry.QUERIES)


def core_sql() -> dict[str, str]:
    from lodestrand.plans import registry

    _load()
    return dict(registry.SQL)
