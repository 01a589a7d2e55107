"""Names of the registered queries and, where SQL can say the same, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue_queries, embedding_queries, events_queries, training_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (events_queries, embedding_queries, catalogue_queries, training_queries)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
