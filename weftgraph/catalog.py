"""The named queries of the library and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import cleaning_queries, client_queries, graph_queries, resolution_queries, sequence_queries, text_queries

_MODULES = [graph_queries, text_queries, cleaning_queries, resolution_queries, sequence_queries, client_queries]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hop prerequisites of the busiest concept of a session."""
    return graph_queries.QUERIES["expand_basic_d2"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
