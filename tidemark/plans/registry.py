"""Named queries with their DuckDB equivalents, where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame under its name; sql gives the same rows and columns in DuckDB."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """df with every double rounded and no negative zero, so that results of two engines compare equal; exact: prices, to 8 digits, which have no ties."""
    return df.select(*((F.round(F.col(f"`{n}`"), 8 if n in exact else digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))
