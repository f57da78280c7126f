"""All queries."""

from wharfline.plans import commit_queries, index_queries, model_queries, report_queries, retrieval_queries, search_queries, source_queries, status_queries, upkeep_queries  # noqa: F401
from wharfline.plans.registry import CATALOG

__all__ = ["CATALOG"]
