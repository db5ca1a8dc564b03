"""Registration of queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles at a fixed number of decimals, so sums in another order compare equal.

    Interpolated percentiles often end exactly in a 5; a nudge far below the last kept
    digit then decides the rounding, in the SQL text as well.
    """
    return df.select(*[
        F.round(F.col(f.name) + nudge, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in df.schema.fields
    ])
