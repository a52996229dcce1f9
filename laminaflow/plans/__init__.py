"""Registered queries over the given tables."""

from laminaflow.plans.catalog import QUERIES, SQL
from laminaflow.plans import (  # noqa: F401  (import registers the queries)
    entity_queries, link_queries, session_queries, signal_queries, stream_queries, text_queries)

__all__ = ["QUERIES", "SQL"]
