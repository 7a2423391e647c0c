"""All queries of the engine by name, with DuckDB's SQL for each that SQL can express."""

from __future__ import annotations

from . import extras, matching, monitor, projections, receipt_queries, receipts, recipe_queries, recipes, recommend, shelf, silver  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
