"""Registry of named queries and their DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame``; its oracle (optional) is SQL
over the driver's tables.  Results are checked on exploded scalar rows,
doubles rounded to 9 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from quorum.plans import (  # noqa: F401
        distribution_queries,
        survey_queries,
        metrics_queries,
        prompt_queries,
        sequence_queries,
        relevance_queries,
        compare_queries,
        safety_queries,
        io_queries,
        catalogue_queries,
        hook_queries,
        stream_queries,
    )
