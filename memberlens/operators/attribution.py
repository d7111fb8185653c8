"""Additive attribution of the linear transition model.

The score of a class is intercept + sum of coefficient x value. Measured from
the mean member, each feature contributes coefficient x (value - mean); the
contributions and the base value add up to the score exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.functions.exprs import filled
from memberlens.functions.vectors import array_lit, array_sum
from memberlens.operators.transitions import TransitionModel

EVIDENCE_ITEMS = 3


def feature_means(df: DataFrame, columns: list[str]) -> list[float]:
    row = df.agg(*[F.avg(filled(c)).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return [float(row[f"_{i}"] or 0.0) for i in range(len(columns))]


def _coefficients(model: TransitionModel) -> tuple[list[list[float]], list[float]]:
    matrix = model.classifier.coefficientMatrix.toArray()
    return [[float(v) for v in row] for row in matrix], [float(v) for v in model.classifier.interceptVector.toArray()]


def contributions(df: DataFrame, model: TransitionModel, means: list[float], label: Column) -> DataFrame:
    """Adds `contribution` (array in feature order), `base_value` and `score` of the given class."""
    coefficients, intercepts = _coefficients(model)
    row = F.element_at(F.array(*[array_lit(c) for c in coefficients]), (label + 1).cast("int"))
    values = F.array(*[filled(c) for c in model.columns])
    centred = F.zip_with(values, array_lit(means), lambda v, m: v - m)
    base = [b + sum(c * m for c, m in zip(cs, means)) for cs, b in zip(coefficients, intercepts)]
    return df.withColumns({
        "contribution": F.zip_with(centred, row, lambda v, c: v * c),
        "base_value": F.element_at(array_lit(base), (label + 1).cast("int")),
        "score": array_sum(F.zip_with(values, row, lambda v, c: v * c)) + F.element_at(array_lit(intercepts), (label + 1).cast("int"))})


def additivity_error(explained: DataFrame) -> DataFrame:
    """Largest difference between base value + contributions and the score."""
    gap = F.abs(array_sum(F.col("contribution")) + F.col("base_value") - F.col("score"))
    return explained.agg(F.max(gap).alias("max_error"), F.count(F.lit(1)).alias("n_rows"))


def assert_additive(explained: DataFrame, tolerance: float = 1e-2) -> None:
    error = additivity_error(explained).first().max_error
    if error is not None and error > tolerance:
        raise AssertionError(f"contributions do not add up to the score (error {error})")


def top_drivers(explained: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """The features with the largest |contribution| and a readable evidence text."""
    items = F.zip_with(F.array(*[F.lit(c) for c in columns]), F.arrays_zip(F.array(*[filled(c) for c in columns]).alias("v"), F.col("contribution").alias("c")),
                       lambda name, pair: F.struct((-F.abs(pair["c"])).alias("rank"), name.alias("feature"), pair["v"].alias("value"), pair["c"].alias("contribution")))
    ordered = F.slice(F.array_sort(items), 1, top)
    drivers = F.transform(ordered, lambda d: F.struct(
        d["feature"].alias("feature"), d["value"].alias("value"), d["contribution"].alias("contribution"),
        F.when(d["contribution"] > 0, "raises").otherwise("lowers").alias("direction")))
    text = F.array_join(F.transform(F.slice(drivers, 1, EVIDENCE_ITEMS), lambda d: F.concat(
        d["feature"], F.lit("="), F.format_string("%.4g", d["value"]), F.lit(" "), d["direction"], F.lit(" "),
        F.format_number(F.abs(d["contribution"]), 3))), "; ")
    return explained.withColumn("drivers", drivers).withColumn("evidence", text)


def global_attribution(df: DataFrame, model: TransitionModel, means: list[float]) -> DataFrame:
    """Mean |contribution| per feature and class, its average and the class it matters most for."""
    coefficients, _ = _coefficients(model)
    # |coefficient| is constant per class, so the mean absolute deviation of each feature is enough
    deviations = df.agg(*[F.avg(F.abs(filled(c) - F.lit(m))).alias(f"_{i}") for i, (c, m) in enumerate(zip(model.columns, means))])
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(k).alias("label"), (F.col(f"_{i}") * F.lit(abs(coefficients[k][i]))).alias("mean_abs"))
        for i, c in enumerate(model.columns) for k in range(len(coefficients))])
    long = deviations.select(F.explode(rows).alias("r")).select("r.*")
    return (long.groupBy("feature").agg(F.avg("mean_abs").alias("overall"), F.max_by("label", F.struct("mean_abs", -F.col("label"))).alias("strongest_class"),
                                        F.sort_array(F.collect_list(F.struct("label", "mean_abs"))).alias("by_class"))
            .orderBy(F.desc("overall"), "feature"))
