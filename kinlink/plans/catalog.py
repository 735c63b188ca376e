"""All queries of the engine: importing the query modules registers them."""

from kinlink.plans import decision_queries, file_queries, pair_queries, text_queries  # noqa: F401
from kinlink.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
