"""The queries of this package over the driver tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duologue.session import ship

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def keep(fn: Runner) -> Runner:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return keep
