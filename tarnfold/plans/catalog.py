"""Registered queries of the reference-style operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnfold.plans import analysis, consolidate, fitted, fulltext, graphs, merged, misc, runs, search, states, stores, streams, synced, texts, time, versions  # noqa: F401
from tarnfold.plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: BM25 and vector candidates, fused."""
    return search.hybrid_search(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
