"""Expressions over probability and value arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_lit(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def argmax(values: Column) -> Column:
    """Index from 0 of the largest element, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - F.lit(1)).cast("int")


def dot(left: Column, right: Column) -> Column:
    return array_sum(F.zip_with(left, right, lambda a, b: a * b))


def renormalised(values: Column, fallback: Column | None = None) -> Column:
    """Scale to sum 1. Rows that sum to (almost) 0 use the fallback, else the uniform vector."""
    dead = array_sum(values) <= F.lit(1e-12)
    spare = F.transform(values, lambda _: F.lit(1.0)) if fallback is None else fallback
    live = F.when(dead, spare).otherwise(values)
    return F.transform(live, lambda x: x / array_sum(live))


def element(values: Column, index: Column) -> Column:
    """Element at an index counted from 0."""
    return F.element_at(values, (index + F.lit(1)).cast("int"))
