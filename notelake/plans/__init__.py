"""Registered queries with their DuckDB counterparts."""

from notelake.plans import extraction, queries_eval, queries_fulltext, queries_links, queries_memory, queries_search, queries_streams, queries_sync  # noqa: F401
from notelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
