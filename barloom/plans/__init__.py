"""The registered queries: each module of this folder adds its own with @query."""

from __future__ import annotations

from barloom.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
