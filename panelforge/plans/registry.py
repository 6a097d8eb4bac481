"""Registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.plans import file_queries, model_queries, relational_queries, scalar_queries

_ALL = file_queries.Q_ | scalar_queries.Q_ | relational_queries.Q_ | model_queries.Q_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, (f, _) in _ALL.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
FLAGSHIP = model_queries.flagship
