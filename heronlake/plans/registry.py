"""All registered queries of the library, and the SQL twins that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heronlake.plans import catalog_queries, diagnose_queries, discovery_queries, ingest_queries, lake_queries, recall_queries, source_queries

MODULES = (recall_queries, catalog_queries, discovery_queries, diagnose_queries, ingest_queries, lake_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
