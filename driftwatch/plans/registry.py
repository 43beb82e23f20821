"""Where queries are registered with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name; ``sql`` may begin with names of common tables to define."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def with_tables(names: str, body: str) -> str:
    """SQL with the common tables of ``views.SQL_TABLES`` in front."""
    from driftwatch.plans.views import SQL_TABLES

    tables = ",\n".join(SQL_TABLES[name] for name in names.split())
    return f"WITH {tables}" + (",\n" if body.lstrip().startswith("+") else "\n") + body.lstrip().removeprefix("+")
