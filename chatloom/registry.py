"""All chat queries by name, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries as registered
from .plans import exchange, records, rounds  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registered.SQL)
