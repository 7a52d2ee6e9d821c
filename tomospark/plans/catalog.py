"""All queries by name with their SQL, where SQL can express them."""

from __future__ import annotations

from . import annotation_queries, volume_queries

QUERIES = {**annotation_queries.QUERIES, **volume_queries.QUERIES}
ORACLES = {**annotation_queries.ORACLES, **volume_queries.ORACLES}
