"""All queries of the engine by name, and the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from psephos.plans import analytics, extras, paperwork, scopes  # noqa: F401  (the others register their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: analytics.run(name) for name in analytics.REGISTRY}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in analytics.REGISTRY.items() if sql is not None}
