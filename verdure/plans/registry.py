"""Query registry: key -> (Spark plan builder, DuckDB oracle SQL or None)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import r6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals (same rule as the oracle text) and
    render DATE / TIMESTAMP columns as ISO strings (microseconds), so both engines
    hand over identical values."""
    def conv(c, t):
        if t in ("double", "float"):
            return r6(c).alias(c)
        if t == "date":
            return F.col(c).cast("string").alias(c)
        if t.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
        return F.col(c)
    return df.select(*[conv(c, t) for c, t in df.dtypes])
