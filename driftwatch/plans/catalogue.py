"""The registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from driftwatch.plans import interval_queries, set_queries, signal_queries, stream_queries  # noqa: F401  they register themselves
from driftwatch.plans.registry import QUERIES, SQL


def queries() -> dict:
    """Queries by name; each takes (spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query."""
    return dict(SQL)
