"""Where queries and their oracles meet: @query(name, sql) registers a function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *ctes: str, sql: str | None = None):
    """Register a query; sql is its DuckDB form, with the CTEs before it."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return put
