"""All queries on the reference's own operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplolake.plans.roles import Roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Callable[[Roles], DataFrame]], Callable[[Roles], DataFrame]]:
    """Register a query over role frames together with its SQL twin."""

    def add(f: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: f(Roles(spark, folder))
        ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded alike in both engines."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


from haplolake.plans import domain_queries, primitive_queries, report_queries  # noqa: E402, F401  they register themselves
