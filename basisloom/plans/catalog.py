"""All queries of the library, in one place."""

from __future__ import annotations

from . import market_queries, series_queries, strategy_queries, table_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
