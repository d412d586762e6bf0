"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.plans import evaluate, operations, relational, runs, search, serve, stream, texts
from gleanery.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluate", "flagship", "operations", "relational", "runs", "search", "serve", "stream", "texts"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that entry() runs."""
    return QUERIES["bm25_topk"](spark, sf_dir)
