"""All registered queries of the engine proper."""

from __future__ import annotations

from . import queries_items, queries_joins, queries_kept, queries_more, queries_prices, queries_rules, queries_scans, queries_sources, queries_state, queries_streams, queries_writes  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
