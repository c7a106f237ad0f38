"""All queries of the core, by name, and their SQL counterparts."""

from embedflow.plans import config_queries, protocol_queries, retrieval_queries, token_queries, vector_queries  # noqa: F401
from embedflow.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
