"""Registry of named plans: each is ``fn(spark, sf_dir) -> DataFrame`` plus an
optional DuckDB oracle SQL text over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import as_output, prepare

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    def deco(fn: Plan) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return as_output(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        PLANS[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco
