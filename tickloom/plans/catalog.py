"""Queries over the driver's tables, at least one for each operator, with the SQL that must give the same rows.

The modules ``market`` and ``models`` hold the queries; each gives name, function and SQL (None where SQL can't say it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans import market, models

Query = Callable[[SparkSession, str], DataFrame]


def entries() -> dict[str, tuple[Query, str | None]]:
    return {**market.ENTRIES, **models.ENTRIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars to filtered events, barrier labels and their uniqueness."""
    return market.flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in entries().items() if sql is not None}
