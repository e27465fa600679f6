"""All registered queries of the matching engine, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinweave.plans import estimation_queries, graph_queries, kernel_queries, log_queries, match_queries, model_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **kernel_queries.QUERIES,
    **match_queries.QUERIES,
    **log_queries.QUERIES,
    **model_queries.QUERIES,
    **graph_queries.QUERIES,
    **estimation_queries.QUERIES,
}
ORACLES: dict[str, str] = {**kernel_queries.ORACLES, **match_queries.ORACLES, **log_queries.ORACLES, **model_queries.ORACLES, **graph_queries.ORACLES, **estimation_queries.ORACLES}
