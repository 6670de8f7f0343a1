"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from floodgauge.plans import counter_queries, incident_queries, log_queries, source_queries, stream_queries

_PARTS = (log_queries, incident_queries, counter_queries, stream_queries, source_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.SQL.items()}
