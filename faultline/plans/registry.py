"""Registered queries and their check queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(key: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query under `key`, with the SQL that must give the same rows if there is any."""
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ship(spark), sf_dir)

        QUERIES[key] = run
        if check is not None:
            CHECKS[key] = check
        return fn

    return add
