"""Registered queries by name, and the DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.plans import cache_queries, check_queries, context_queries, evaluation_queries, library_queries, request_pipeline, routing_queries, source_queries, stream_queries, traffic_queries

_AREAS = (cache_queries, context_queries, routing_queries, traffic_queries, check_queries, evaluation_queries, source_queries, library_queries, stream_queries, request_pipeline)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for area in _AREAS for name, query in area.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for area in _AREAS for name, sql in area.ORACLE_SQL.items()}
