"""Exact order statistics without a single-task sort.

A window over the whole table would put every row into one task. Here equal
values are first collapsed by a map-side combined count, so a value that makes
up a third of the table becomes one row. The distinct values are then exchanged by range of
group and value: every partition is a slice that is ordered on its own, and the rows in earlier
slices of the group are added as an offset. The slices are as many as the data fills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.session import cut_lineage, small_side


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "feature",
            value: str = "value") -> DataFrame:
    """Long form (keep…, name, value) of numeric columns."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), name, value)


def ranked_values(df: DataFrame, value: str, groups: Sequence[str] = (),
                  weights: dict[str, Column] | None = None, slices: int | None = None, previous: str | None = None) -> DataFrame:
    """One row per distinct non-null value of each group.

    Adds for every weight (default: `n`, the row count) the weight of the value
    itself, `<w>_below` for all smaller values and `<w>_total` for the group; and the next smaller value as `previous`, if
    it is named. `slices` fixes the number of slices; without it they follow the size of the distinct values.
    """
    weights = weights or {"n": F.count(F.lit(1))}
    keys = list(groups) or ["_all"]
    source = df if groups else df.withColumn("_all", F.lit(1))
    counted = (source.where(F.col(value).isNotNull())
               .groupBy(*keys, value).agg(*[w.alias(n) for n, w in weights.items()]))
    ranges = [*([slices] if slices else []), *keys, value]
    sliced = cut_lineage(counted.repartitionByRange(*ranges).withColumn("_slice", F.spark_partition_id()))

    # a row per group and slice that holds some of it
    edges = sliced.groupBy(*keys, "_slice").agg(*[F.sum(n).alias(f"_{n}") for n in weights], F.max(value).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = small_side(edges.select(
        *keys, "_slice", F.max("_last").over(earlier).alias("_last"),
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_before") for n in weights],
        *[F.sum(f"_{n}").over(whole).alias(f"{n}_total") for n in weights]))

    order = Window.partitionBy(*keys, "_slice").orderBy(value)
    inside = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.join(offsets, [*keys, "_slice"])
    below = [(F.col(f"_{n}_before") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_below") for n in weights]
    before = [F.coalesce(F.lag(value).over(order), F.col("_last")).alias(previous)] if previous else []
    return ranked.select(*groups, value, *weights, *below, *[f"{n}_total" for n in weights], *before)


def quantiles_from_ranks(ranked: DataFrame, value: str, probs: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles, one output column per entry of `probs`."""
    position = {name: p for name, p in probs.items()}
    picks = []
    for name, p in position.items():
        place = (F.col("n_total") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        for side, at in (("lo", low), ("hi", high)):
            holds = (F.col("n_below") <= at) & (at < F.col("n_below") + F.col("n"))
            picks.append(F.max(F.when(holds, F.col(value))).alias(f"_{name}_{side}"))
        picks.append(F.max(place - low).alias(f"_{name}_w"))
    edges = ranked.groupBy(*groups).agg(*picks)
    return edges.select(*groups, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n) for n in position])


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    return quantiles_from_ranks(ranked_values(df, value, groups), value, probs, groups)


def average_rank_share() -> Column:
    """Share of rows at or below a value, ties counted by their average rank."""
    return (F.col("n_below") + (F.col("n") + 1) / F.lit(2.0)) / F.col("n_total")
