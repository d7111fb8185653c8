"""Column expressions shared by the operators. All of them stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# Accepted date layouts. Single-letter fields accept both padded
# and unpadded numbers. Separators tell the layouts apart, so a value is parsed
# once instead of being tried against each of them.
ISO_TIME = "yyyy-M-d H:m:s"
DAY_FIRST_TIME = "d/M/yyyy H:m:s"
ISO_DATE = "yyyy-M-d"
DAY_FIRST_DATE = "d/M/yyyy"


def ts(value: str) -> Column:
    """Timestamp literal from 'yyyy-MM-dd' or 'yyyy-MM-dd HH:mm:ss'."""
    return F.lit(value).cast("timestamp")


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where the denominator is 0 or either side is null."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a column on one or both sides; nulls stay null."""
    bounded = value
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    # greatest/least skip nulls, so a null would otherwise become the bound itself
    return F.when(value.isNotNull(), bounded)


def filled(name: str, fill: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(fill))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour spans between two instants, rounded down (also for negative spans)."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(micros / F.lit(float(MICROS_PER_DAY))).cast("long")


def half_even(value: Column, digits: int) -> Column:
    """Round the scaled value to the nearest integer, ties to even, then scale back."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def shortest_text(value: Column, digits: int) -> Column:
    """Text of a rounded number with at least one and no surplus decimals: 2.0, 0.5, 0.37."""
    exact = half_even(value, digits).cast(f"decimal(28,{max(digits, 1)})").cast("string")
    return F.regexp_replace(exact, r"(\.\d+?)0+$", "$1")


def parse_timestamp(text: Column) -> Column:
    """Timestamp in one of the accepted layouts; null when none fits."""
    def read(layout: str) -> Column:
        return F.try_to_timestamp(text, F.lit(layout))

    timed = text.contains(":")
    return F.when(text.contains("/"), F.when(timed, read(DAY_FIRST_TIME)).otherwise(read(DAY_FIRST_DATE))).otherwise(
        F.when(timed, read(ISO_TIME)).otherwise(read(ISO_DATE)))


def indicator(condition: Column) -> Column:
    """1 where the condition holds, 0 elsewhere (null counts as no)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_where(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


def lookup(key: Column, table: dict, default=None) -> Column:
    """CASE over a small fixed table."""
    result = None
    for name, value in table.items():
        result = F.when(key == name, F.lit(value)) if result is None else result.when(key == name, F.lit(value))
    return result.otherwise(F.lit(default))
