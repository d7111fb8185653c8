"""Checks of a feature panel: nulls, ranges, business rules, collinearity, stability."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberlens.functions.exprs import count_where, half_even
from memberlens.functions.ranking import exact_quantiles, unpivot
from memberlens.functions.scalars import beside
from memberlens.session import shipped, small_side

shipped(__name__)

# Domain bounds of the checked features.
RANGES = {
    "redemption_rate": (0.0, 1.0),
    "email_click_rate_30d": (0.0, 1.0),
    "category_diversity_90d": (0.0, 1.0),
    "channel_diversity_90d": (0.0, 1.0),
    "tier_ordinal": (0.0, 3.0),
    "recency_days": (0.0, 2000.0),
    "browse_to_purchase_ratio_30d": (0.0, 10.0),
    "hoarding_ratio": (0.0, 10.0),
    "feature_complete": (0.0, 1.0),
    "browsed_but_never_purchased_30d": (0.0, 1.0),
}

# Columns that are no features, or null by design.
NULLABLE = (
    "member_id", "observation_date", "last_transaction_date", "account_open_date", "current_tier",
    "tier_trajectory_direction", "recency_days", "months_since_last_tier_change")

NOT_CORRELATED = (
    "member_id", "observation_date", "last_transaction_date", "account_open_date", "feature_complete",
    "tier_trajectory_direction", "current_tier", "browsed_but_never_purchased_30d")


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in without]


def _long(df: DataFrame, keys: Sequence[str], rows: list[Column]) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def missing_features(panel: DataFrame, limit: float = 0.05, by: Sequence[str] = ("observation_date",)) -> DataFrame:
    """Features whose null rate exceeds the limit."""
    columns = [c for c in panel.columns if c not in NULLABLE]
    one = panel.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("feature"), ((F.col("_n") - F.col(f"_{i}")) / F.col("_n")).alias("null_rate"))
            for i, c in enumerate(columns)]
    return _long(one, by, rows).where(F.col("null_rate") > limit)


def range_violations(panel: DataFrame, ranges: dict = RANGES, by: Sequence[str] = ("observation_date",)) -> DataFrame:
    """Count, smallest and largest value of every feature that leaves its domain."""
    checked = {c: r for c, r in ranges.items() if c in panel.columns}
    aggs = []
    for i, (c, (low, high)) in enumerate(checked.items()):
        v = F.col(c).cast("double")
        aggs += [count_where((v < low) | (v > high)).alias(f"_n{i}"), F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}")]
    one = panel.groupBy(*by).agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"_n{i}").alias("n_violations"),
                     F.col(f"_lo{i}").alias("min_value"), F.col(f"_hi{i}").alias("max_value"))
            for i, c in enumerate(checked)]
    return _long(one, by, rows).where(F.col("n_violations") > 0)


def business_rules(panel: DataFrame, by: Sequence[str] = ("observation_date",)) -> DataFrame:
    """Every consistency rule with its count of offending rows and whether it failed."""
    def is_infinite(c: str) -> Column:
        return F.abs(F.col(c).cast("double")) == F.lit(float("inf"))

    never = F.col("purchase_count_180d") == 0
    rules = {f"zero_count_with_spend_{w}": (F.col(f"purchase_count_{w}") == 0) & (F.col(f"spend_total_{w}") > 0)
             for w in ("7d", "30d", "90d", "180d")}
    rules["null_recency_with_purchases"] = F.col("recency_days").isNull() & (F.col("purchase_count_30d") > 0)
    rules["redemption_rate_out_of_bounds"] = ~F.col("redemption_rate").between(0, 1)
    rules.update({f"infinite_{c}": is_infinite(c)
                  for c in ("spend_slope_30d", "frequency_slope_30d", "spend_acceleration") if c in panel.columns})
    aggs = [count_where(rule).alias(name) for name, rule in rules.items()]
    complete = F.avg(F.when(never, F.col("feature_complete").cast("double")))
    one = panel.groupBy(*by).agg(*aggs, count_where(never).alias("_never"), complete.alias("_complete"))
    rows = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_rows"), (F.col(n) > 0).alias("failed")) for n in rules]
    too_complete = F.coalesce(F.col("_complete") > 0.3, F.lit(False))
    rows.append(F.struct(F.lit("completeness_of_never_purchased").alias("rule"), F.col("_never").alias("n_rows"),
                         too_complete.alias("failed")))
    return _long(one, by, rows)


def pair_moments(values: np.ndarray) -> np.ndarray:
    """Of all pairs of columns, over the rows where both are known: rows, sums of the first, of its square, and of the product."""
    known = ~np.isnan(values)
    x, m = np.where(known, values, 0.0), known.astype(float)
    return np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])


def correlations(moments: np.ndarray) -> np.ndarray:
    """Pearson's r of all pairs from their moments; NaN where a column is constant."""
    n, sx, sxx, sxy = moments
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = n * sxx - sx * sx
        spread[spread <= 1e-12 * n * sxx] = np.nan
        return (n * sxy - sx * sx.T) / np.sqrt(spread * spread.T)


def collinear_pairs(panel: DataFrame, threshold: float = 0.90, columns: Sequence[str] | None = None,
                    by: Sequence[str] = ("observation_date",)) -> DataFrame:
    """Feature pairs with |r| above the threshold, nulls dropped per pair; default: all numeric columns.

    One pass: tasks add up the products of values and of their null masks, a block matrix per group from which the moments of all
    pairs follow. A constant column has no correlation.
    """
    columns, by = list(columns or numeric_columns(panel, NOT_CORRELATED)), list(by)
    if not columns:
        raise ValueError("there are no numeric columns")
    numbers = panel.select(*by, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    # correlations do not change under a shift; near the values of some row sums of squares stay small
    some = numbers.limit(1).collect()
    shift = np.array([0.0 if not some or v is None else v for v in (some[0][len(by):] if some else [0.0] * len(columns))])
    size = len(columns)
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbers.select(*by).schema)

    def grouped(b: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        names = list(zip(*(b.column(c).to_pylist() for c in by), strict=True)) if by else [()] * b.num_rows
        number = {k: i for i, k in enumerate(dict.fromkeys(names))}
        yield from ((k, np.flatnonzero(np.fromiter((number[x] for x in names), np.int64, len(names)) == i)) for k, i in number.items())

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        kinds = None
        for b in batches:
            kinds = [b.column(c).type for c in by]
            values = np.stack([b.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(size)], axis=1) - shift
            for key, rows in grouped(b):
                total[key] = total.get(key, 0.0) + pair_moments(values[rows])
        for key, m in total.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(key, kinds, strict=True)], pa.array([m.tobytes()], pa.binary())], [*by, "_m"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        kinds = None
        for b in batches:
            kinds = [b.column(c).type for c in by]
            for *key, m in zip(*(b.column(c).to_pylist() for c in [*by, "_m"]), strict=True):
                total[tuple(key)] = total.get(tuple(key), 0.0) + np.frombuffer(m).reshape(4, size, size)
        for key, m in total.items():
            r = np.abs(np.triu(correlations(m), 1))
            i, j = np.nonzero(np.nan_to_num(r) > threshold)
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(i), t) for v, t in zip(key, kinds, strict=True)], pa.array([columns[k] for k in i], pa.string()), pa.array([columns[k] for k in j], pa.string()),
                                              pa.array(np.minimum(r[i, j], 1.0))], [*by, "feature_a", "feature_b", "r"])

    parts = numbers.mapInArrow(added, ", ".join(filter(None, [keys, "_m binary"])))
    dealt = parts.repartition(*by) if by else parts.repartition(1)
    return dealt.mapInArrow(merged, ", ".join(filter(None, [keys, "feature_a string, feature_b string, r double"])))


def structural_pairs(pairs: DataFrame, min_months: int = 8) -> DataFrame:
    """Pairs flagged in at least `min_months` months."""
    low, high = F.least("feature_a", "feature_b"), F.greatest("feature_a", "feature_b")
    return (pairs.groupBy(low.alias("feature_a"), high.alias("feature_b"))
            .agg(F.countDistinct("observation_date").alias("n_months"), F.avg("r").alias("avg_r"))
            .where(F.col("n_months") >= min_months))


def median_trajectory(panel: DataFrame, columns: Sequence[str], jump: float = 0.5) -> DataFrame:
    """Monthly medians with their relative change; `is_jump` marks changes above the limit."""
    medians = exact_quantiles(unpivot(panel, columns, ["observation_date"]), "value", {"median_value": .5},
                              ["observation_date", "feature"])
    before = F.lag("median_value").over(Window.partitionBy("feature").orderBy("observation_date"))
    change = F.abs(F.try_divide(F.col("median_value") - before, before))
    # 0 -> x is an infinite change and counts as a jump, 0 -> 0 is undefined
    from_zero = (before == 0) & (F.col("median_value") != 0)
    return medians.withColumn("change", change).withColumn(
        "is_jump", F.coalesce(change > jump, F.lit(False)) | F.coalesce(from_zero, F.lit(False)))


def psi_from_bins(counts: DataFrame, keys: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """PSI per key from (keys, bin, n_expected, n_actual).

    Rows with a null bin lie outside the bins: they count in the total only.
    """
    whole = Window.partitionBy(*keys)
    share = counts.withColumns({
        "_e": F.greatest(F.col("n_expected") / F.sum("n_expected").over(whole), F.lit(floor)),
        "_a": F.greatest(F.col("n_actual") / F.sum("n_actual").over(whole), F.lit(floor))})
    term = F.when(F.col("bin").isNotNull(), (F.col("_e") - F.col("_a")) * F.log(F.col("_e") / F.col("_a")))
    return share.groupBy(*keys).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("psi"))


EDGE_DIGITS = 9  # decimals that values and bin edges are compared by


def equal_width_psi(expected: DataFrame, actual: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """PSI over equal-width bins of the expected sample, per key.

    Both inputs have the keys and a `value`. Actual values beyond the expected
    range fall into no bin but stay in the denominator. Values and edges are rounded to EDGE_DIGITS decimals, so that a
    value on an edge falls on the same side however its sums were formed. Rows are counted by bin in the tasks: only counts shuffle.
    """
    known = lambda df: df.where(F.col("value").isNotNull()).withColumn("value", half_even(F.col("value"), EDGE_DIGITS))
    span = known(expected).groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    # a constant sample gets a unit-wide range around its value
    flat = F.col("_lo") == F.col("_hi")
    span = span.select(*keys, F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                       F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    low, high = F.col("_lo"), F.col("_hi")
    edges = F.array(*[half_even(low + (high - low) / F.lit(float(bins)) * F.lit(float(i)), EDGE_DIGITS) for i in range(1, bins)])
    span = small_side(span.withColumn("_edges", edges))
    v = F.col("value")
    place = F.when(v.between(low, high), F.size(F.filter("_edges", lambda e: e <= v)))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = known(expected).select(*keys, "value", one.alias("_e"), none.alias("_a")).unionByName(known(actual).select(*keys, "value", none.alias("_e"), one.alias("_a")))
    binned = both.join(span, list(keys)).groupBy(*keys, place.alias("bin"))
    return psi_from_bins(binned.agg(F.sum("_e").alias("n_expected"), F.sum("_a").alias("n_actual")), keys)


def monthly_psi(panel: DataFrame, columns: Sequence[str], minimum: float = 0.1) -> DataFrame:
    """PSI of every feature between consecutive dates of the panel, above the reporting limit.

    Every row serves twice: as the sample of its own date and as the reference of the following date.
    """
    dates = panel.select("observation_date").distinct()
    order = Window.orderBy("observation_date")  # one row per date
    pairs = small_side(dates.select("observation_date", F.lead("observation_date").over(order).alias("_next")))
    long = unpivot(panel, columns, ["observation_date"])
    expected = (long.join(pairs.where(F.col("_next").isNotNull()), "observation_date")
                .select(F.col("_next").alias("observation_date"), "feature", "value"))
    first = dates.agg(F.min("observation_date").alias("_first"))
    actual = beside(long, first).where(F.col("observation_date") > F.col("_first")).drop("_first")
    return equal_width_psi(expected, actual, ["observation_date", "feature"]).where(F.col("psi") > minimum)


def validation_report(panel: DataFrame) -> DataFrame:
    """Failure counts and pass flag per month."""
    months = panel.select("observation_date").distinct()
    nulls = missing_features(panel).groupBy("observation_date").agg(F.count(F.lit(1)).alias("n_missing"))
    ranges = range_violations(panel).groupBy("observation_date").agg(F.count(F.lit(1)).alias("n_range"))
    sanity = business_rules(panel).groupBy("observation_date").agg(count_where(F.col("failed")).alias("n_sanity"))
    report = months
    for part in (nulls, ranges, sanity):
        report = report.join(part, "observation_date", "left")
    report = report.na.fill(0, ["n_missing", "n_range", "n_sanity"])
    return report.withColumn("passed", (F.col("n_missing") + F.col("n_range") + F.col("n_sanity")) == 0)


def overall_verdict(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("n_months"), count_where(F.col("passed")).alias("n_passed"),
                      F.every("passed").alias("all_passed"))
