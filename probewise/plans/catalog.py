"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from probewise.plans import event_queries, search_queries, table_queries, vector_queries, verify_queries
from probewise.plans.registry import QUERIES, SQL

MODULES = (vector_queries, search_queries, verify_queries, table_queries, event_queries)

__all__ = ["MODULES", "QUERIES", "SQL"]
