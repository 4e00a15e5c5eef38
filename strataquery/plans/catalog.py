"""The registered queries of the engine and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataquery.plans import document_queries, path_queries, version_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = version_queries.QUERIES | document_queries.QUERIES | path_queries.QUERIES
ORACLE_SQL: dict[str, str] = version_queries.ORACLE_SQL | document_queries.ORACLE_SQL | path_queries.ORACLE_SQL
