"""Queries: operators applied to the given tables, and the SQL that checks them."""

from tidepool.plans import index_queries, label_queries, search_queries  # noqa: F401 - they register themselves
from tidepool.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
