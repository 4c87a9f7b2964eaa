"""Queries by name, and DuckDB SQL for the same rows where SQL can express them."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def chained(*parts: str) -> str:
    """WITH and its named parts."""
    return "WITH " + ", ".join(p.strip() for p in parts)
