"""Every operator bound to the test tables, each with its SQL counterpart."""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
