"""All registered queries and their oracle SQL."""

from quillon.plans import change_queries, engine_queries, function_queries, json_queries, relational_queries, source_queries, sql_queries, window_queries  # noqa: F401
from quillon.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
