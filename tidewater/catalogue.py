"""The registered queries and, beside each, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans import queries, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in queries.ALL}
ORACLE_SQL: dict[str, str] = {name: text for name, text in sql.build().items() if name in QUERIES}
