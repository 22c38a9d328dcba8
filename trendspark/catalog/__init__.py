"""Registered queries (Spark) and their oracle SQL (DuckDB), keyed by name."""

from trendspark.catalog import (  # noqa: F401  (registers queries)
    q_analytics, q_contract, q_extra, q_features, q_ml, q_progress, q_scoring, q_sinks, q_text, q_train)
from trendspark.catalog.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
