"""Registry of named queries; each takes (spark, data directory) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Round double columns so that results compare across engines."""
    return df.select(*[
        F.round(F.col(f"`{name}`"), per_column.get(name, digits)).alias(name)
        if kind == "double" else F.col(f"`{name}`") for name, kind in df.dtypes])


def query(name: str, **per_column: int) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf), **per_column)
        return fn
    return register
