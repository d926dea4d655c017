"""Named queries over the driver tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duologue.plans.rounding import ROUNDED
from duologue.session import ship

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL for the same result.

    Engines add floating-point numbers in different orders, so such columns are rounded to six places on
    both sides, as the last step.
    """
    floats = ROUNDED.get(name, [])

    def keep(fn: Runner) -> Runner:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            out = fn(spark, sf_dir)
            return out.withColumns({c: F.round(F.col(c).cast("double"), 6) + 0.0 for c in floats}) if floats else out

        text = sql
        if sql and floats:
            cols = ", ".join(f'round(CAST("{c}" AS DOUBLE), 6) + 0.0 AS "{c}"' for c in floats)
            text = f"SELECT * REPLACE ({cols}) FROM ({sql}) AS result"
        REGISTRY[name] = Query(name, run, text)
        return fn

    return keep


def load_all() -> dict[str, Query]:
    import importlib

    for mod in ("summaries", "shaping", "checks", "joins", "vectors", "windows", "ordering", "sets",
                "sampling", "spaces", "lineage", "ledgers", "live", "files"):
        importlib.import_module(f"duologue.plans.{mod}")
    return REGISTRY
