"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import event_queries, feature_queries, model_queries, session_queries, source_queries, stat_queries, text_queries

_PARTS = (session_queries, source_queries, text_queries, feature_queries, stat_queries, event_queries, model_queries)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES: dict = {k: v for p in _PARTS for k, v in p.ORACLES.items()}
