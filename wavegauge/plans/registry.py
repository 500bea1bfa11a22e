"""Named queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent statement for an independent engine."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns and widen integers so that results compare across engines."""
    out = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = f"round(cast({c} as double), {digits}) + 0.0D as {c}"
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = f"cast({c} as long) as {c}"
        out.append(c)
    return df.selectExpr(*out)


def r(*cols: str, digits: int = 6) -> str:
    """SQL select list of rounded columns."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


def i(*cols: str) -> str:
    """SQL select list of BIGINT columns."""
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)
