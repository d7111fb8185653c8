"""Single-row results used inside other queries."""

from __future__ import annotations

from pyspark.sql import DataFrame


def beside(df: DataFrame, single: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, as scalar subqueries (no join).

    A table with more than one row fails the query.
    """
    return df.withColumns({c: single.select(c).scalar() for c in single.columns})
