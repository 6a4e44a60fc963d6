"""Queries over the driver's tables, one for each operator, with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.queries import engine_tables, interfaces, relational, series

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return series.QUERIES | engine_tables.QUERIES | interfaces.QUERIES | relational.QUERIES


def oracle_sql() -> dict[str, str]:
    return series.SQL | engine_tables.SQL | interfaces.SQL | relational.SQL
