"""How queries are registered: a function of (spark, sf_dir), with the SQL that DuckDB must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register under the function's name; without SQL the query has none (tests hold it against plain Python)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison; no negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def rs(sql: str, digits: int = 6) -> str:
    return f"round({sql}, {digits}) + 0.0::DOUBLE"
