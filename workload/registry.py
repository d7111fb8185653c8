"""Named queries with the SQL they are compared to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double; instants become text. Both engines then print the same values."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            # adding 0.0 turns a negative zero into zero
            out.append((F.round(F.col(name).cast("double"), digits) + F.lit(0.0)).alias(name))
        elif kind == "timestamp":
            out.append(F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def r6(x: str, name: str | None = None, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0" + (f" AS {name}" if name else "")


def when(x: str, name: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS {name}"


def big(x: str, name: str | None = None) -> str:
    return f"CAST({x} AS BIGINT)" + (f" AS {name}" if name else "")
