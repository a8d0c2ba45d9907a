"""All registered queries and their SQL."""

from __future__ import annotations

from . import event_queries, sync_queries

QUERIES = sync_queries.QUERIES | event_queries.QUERIES
ORACLES = sync_queries.ORACLES | event_queries.ORACLES
