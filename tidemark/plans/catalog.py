"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import features, labels, policy
from tidemark.plans import audit_queries, basic_queries, coverage_queries, domain_queries, evidence_queries, research_queries, streaming_queries, window_queries  # noqa: F401  each registers its queries
from tidemark.plans.registry import ORACLE, QUERIES, costs, preds

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars to labels, features, positions and policy metrics by scope."""
    labeled = labels.add_labels(domain_queries.minute_bars(spark, sf_dir))
    matrix = features.build(labeled).select("market", "bar", "training_row_valid")
    frame = policy.frame(preds(spark, sf_dir), costs(spark)).join(matrix, ["market", "bar"])
    return policy.metrics(frame.where(frame["training_row_valid"] | (frame["position"] != 0)))
