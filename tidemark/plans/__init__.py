"""Queries over the driver's tables, each beside its DuckDB equivalent."""

from tidemark.plans import audit_queries, deal_queries, evaluation_queries, experiment_queries, intake_queries, market_queries, model_queries, pit_queries, research_queries, review_queries, source_queries, warehouse_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
