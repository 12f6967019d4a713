"""The registry of the engine's queries and their SQL twins."""

from __future__ import annotations

from lodeworks.plans import reference_queries, skew_queries

MODULES = (reference_queries, skew_queries)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
