"""The core queries and their SQL counterparts."""

from __future__ import annotations

from lorespark.plans import data_queries, eval_queries, graph_queries, record_queries, retrieval_queries

_MODULES = (data_queries, record_queries, retrieval_queries, graph_queries, eval_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.oracle_sql().items()}
