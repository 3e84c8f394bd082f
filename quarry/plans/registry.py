"""A query is a function of (spark, folder) and, where SQL can express it, the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines give one value."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


def seconds(ts: str) -> Column:
    """Epoch seconds of a timestamp column, as a double."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
