"""How queries are registered: a plan, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(keys: str = "", values: str = "", sql: str | None = None, digits: int = 6):
    """Registers a plan under its function's name. keys: columns as they are; values: doubles, which are rounded on both
    sides, as sums of doubles depend on their order in the last digits."""
    k, v = keys.split(), values.split()

    def register(f):
        def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).select(*k, *(F.round(F.col(c).cast("double"), digits).alias(c) for c in v))

        QUERIES[f.__name__] = plan
        if sql:
            chosen = ", ".join([*k, *(f"round(({c})::DOUBLE, {digits}) AS {c}" for c in v)])
            SQL[f.__name__] = f"SELECT {chosen} FROM ({sql}) AS t"
        return f

    return register
