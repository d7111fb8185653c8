"""Calibration of class probabilities (`proba`: array<double>, `seg_next`: the outcome)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.functions.vectors import element, renormalised
from memberlens.operators.metrics import macro_f1, with_decision
from memberlens.session import cut_lineage, shipped, small_side

shipped(__name__)

BINS = 15


def per_class(scored: DataFrame, actual: str = "seg_next", proba: str = "proba") -> DataFrame:
    """One row per (row, class): probability `p` and outcome `y`."""
    each = scored.select(F.col(actual).alias("_actual"), F.posexplode(proba).alias("label", "p"))
    return each.select("label", "p", (F.col("_actual") == F.col("label")).cast("double").alias("y"))


def bin_of(p: Column, bins: int = BINS) -> Column:
    """Equal bins of [0, 1]; 1.0 belongs to the last one."""
    return F.least(F.floor(p * F.lit(float(bins))), F.lit(bins - 1)).cast("long")


def reliability_curve(outcomes: DataFrame, bins: int = BINS, by: Sequence[str] = ("label",)) -> DataFrame:
    """Mean prediction and observed rate of every non-empty bin."""
    b = F.col("bin")
    return (outcomes.groupBy(*by, bin_of(F.col("p"), bins).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed_rate"))
            .select(*by, (b / F.lit(float(bins))).alias("bin_lo"), ((b + 1) / F.lit(float(bins))).alias("bin_hi"), "n",
                    "mean_predicted", "observed_rate", (F.col("mean_predicted") - F.col("observed_rate")).alias("gap")))


def expected_calibration_error(outcomes: DataFrame, bins: int = BINS, by: Sequence[str] = ("label",)) -> DataFrame:
    """Row-weighted mean gap over the bins; 0 without rows."""
    curve = reliability_curve(outcomes, bins, by)
    ece = F.coalesce(F.sum(F.abs("gap") * F.col("n")) / F.sum("n"), F.lit(0.0))
    return curve.groupBy(*by).agg(ece.alias("ece"))


def maximum_calibration_error(outcomes: DataFrame, bins: int = BINS, min_count: int = 50, by: Sequence[str] = ("label",)) -> DataFrame:
    """Largest gap among bins with at least `min_count` rows, 0 if there is none."""
    curve = reliability_curve(outcomes, bins, by)
    return curve.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("n") >= min_count, F.abs("gap"))), F.lit(0.0)).alias("mce"))


def brier_scores(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("label").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg("p").alias("mean_predicted"),
                                         F.avg("y").alias("base_rate"))


def mean_log_loss(actual: str = "seg_next", proba: str = "proba") -> Column:
    """Mean negative log of the probability given to what happened, at least 1e-9 and at most 1."""
    given = element(F.col(proba), F.col(actual))
    return F.avg(-F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-9), given))))


def log_loss(scored: DataFrame, actual: str = "seg_next", proba: str = "proba") -> DataFrame:
    return scored.agg(mean_log_loss(actual, proba).alias("log_loss"))


def calibration_summary(scored: DataFrame, bins: int = BINS, actual: str = "seg_next", proba: str = "proba") -> DataFrame:
    """Brier score, ECE and MCE per class."""
    outcomes = per_class(scored, actual, proba)
    return (brier_scores(outcomes).join(expected_calibration_error(outcomes, bins), "label")
            .join(maximum_calibration_error(outcomes, bins), "label"))


def overall_summary(scored: DataFrame, bins: int = BINS) -> dict[str, float]:
    means = calibration_summary(scored, bins).agg(F.avg("brier").alias("b"), F.avg("ece").alias("e")).first()
    return {"mean_brier": means.b, "mean_ece": means.e, "log_loss": log_loss(scored).first().log_loss,
            "macro_f1": macro_f1(with_decision(scored), "seg_next", "seg_pred").first().macro_f1}


CELLS = 4096  # equal parts of [0, 1] that blocks are looked up by
BLOCKS_PER_RANGE = 250_000
RANGES = "label int, lo double, hi double, hits double, weight double"


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool adjacent violators of sorted (label, lo, hi, hits, weight): neighbours merge until means rise strictly."""
    names = ["label", "lo", "hi", "hits", "weight"]
    stack: list[list] = []

    def out(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.int32(), *[pa.float64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        for row in zip(*(b.column(n).to_pylist() for n in names), strict=True):
            if stack and stack[-1][0] != row[0]:
                yield out(stack)
                stack = []
            stack.append(list(row))
            # hits / weight compared without division
            while len(stack) > 1 and stack[-2][3] * stack[-1][4] >= stack[-1][3] * stack[-2][4]:
                _, _, hi, hits, weight = stack.pop()
                stack[-1][2] = hi
                stack[-1][3] += hits
                stack[-1][4] += weight
    if stack:
        yield out(stack)


def pooled_blocks(points: DataFrame, ranges: int | None = None) -> DataFrame:
    """Isotonic blocks of weighted points (label, p, hits, weight), one point per label and p: label, lo, hi, hits, weight, range.

    Points are cut into ranges of label and p, and each range is pooled on its own. Where the last block of a range does not lie below
    the first of the next, blocks are dealt into other ranges and pooled again, until no border is violated; since violators may be
    pooled in any order, the result is that of one pass. The driver sees two numbers per range.
    """
    blocks = points.select(F.col("label").cast("int").alias("label"), F.col("p").alias("lo"), F.col("p").alias("hi"), F.col("hits").cast("double").alias("hits"), F.col("weight").cast("double").alias("weight"))
    fixed = ranges is not None
    if not fixed:
        blocks = cut_lineage(blocks)
        ranges = max(1, -(-blocks.count() // BLOCKS_PER_RANGE))
    while True:
        dealt = blocks.repartitionByRange(ranges, "label", "lo").sortWithinPartitions("label", "lo")
        blocks = cut_lineage(dealt.mapInArrow(_pool, RANGES).withColumn("range", F.spark_partition_id()))
        if ranges == 1 or not _violated(blocks):
            return blocks
        # fewer ranges each time: borders fall elsewhere, and a single range has none
        ranges = ranges - 1 if fixed else max(1, min(ranges - 1, -(-blocks.count() // BLOCKS_PER_RANGE)))
        blocks = blocks.drop("range")


def _edges(blocks: DataFrame) -> DataFrame:
    """First and last block of every range and label: two rows at most for each border."""
    block = F.struct("lo", "hits", "weight")
    return blocks.groupBy("label", "range").agg(F.min(block).alias("first"), F.max(block).alias("last"))


def _violated(blocks: DataFrame) -> bool:
    """Whether at some border the mean does not rise."""
    edges = sorted(_edges(blocks).collect(), key=lambda r: (r["label"], r["range"]))
    return any(a["label"] == b["label"] and a["last"].hits * b["first"].weight >= b["first"].hits * a["last"].weight for a, b in zip(edges, edges[1:], strict=False))


def fit_isotonic(validation: DataFrame, n_classes: int, actual: str = "seg_next", proba: str = "proba", ranges: int | None = None) -> DataFrame:
    """Isotonic calibration of every class: stored blocks (label, lo, hi, value) with the block that follows (next_lo, next_value).

    Equal probabilities are one weighted point; all classes are fitted together.
    """
    points = per_class(validation, actual, proba).where((F.col("label") < n_classes) & F.col("p").isNotNull())
    # -0.0 and 0.0 are one point
    points = points.groupBy("label", (F.col("p") + F.lit(0.0)).alias("p")).agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("weight"))
    blocks = pooled_blocks(points, ranges)
    within = Window.partitionBy("label", "range").orderBy("lo")  # a range's blocks are bounded in number
    value = F.col("hits") / F.col("weight")
    own = blocks.select("label", "range", "lo", "hi", value.alias("value"), F.lead("lo").over(within).alias("_lo"), F.lead(value).over(within).alias("_value"))
    following = _edges(blocks).select("label", "range", F.col("first.lo").alias("first_lo"), (F.col("first.hits") / F.col("first.weight")).alias("first_value"))
    order = Window.partitionBy("label").orderBy("range")  # one row per range
    following = following.select("label", "range", F.lead("first_lo").over(order).alias("_first_lo"), F.lead("first_value").over(order).alias("_first_value"))
    joined = own.join(small_side(following), ["label", "range"])
    return cut_lineage(joined.select("label", "lo", "hi", "value", F.coalesce("_lo", "_first_lo").alias("next_lo"), F.coalesce("_value", "_first_value").alias("next_value")))


def _cell(p: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor(p * F.lit(float(CELLS))))).cast("int")


def isotonic_cells(blocks: DataFrame, label: int) -> DataFrame:
    """A class's blocks by cell of [0, 1] (`_cell`, `_blocks`): those that begin there, and before them the last one that began earlier."""
    mine = blocks.where(F.col("label") == label)
    block = F.struct("lo", "hi", "value", "next_lo", "next_value")
    own = mine.groupBy(_cell(F.col("lo")).alias("_cell")).agg(F.sort_array(F.collect_list(block)).alias("_own"))
    grid = mine.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("_cell")).join(own, "_cell", "left")
    order = Window.orderBy("_cell")  # CELLS rows
    before = F.last(F.element_at("_own", -1), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    least = F.first(F.element_at("_own", 1), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # below the first block its value holds
    return grid.select("_cell", F.concat(F.array(F.coalesce(before, least)), F.coalesce(F.col("_own"), F.array().cast(own.schema["_own"].dataType))).alias("_blocks"))


def with_isotonic(df: DataFrame, blocks: DataFrame, label: int, p: Column, output: str) -> DataFrame:
    """Adds a class's calibrated probability: inside a block its mean, between two blocks the line between them, beyond the outermost ones their means.

    A class without blocks keeps its probabilities; null stays null.
    """
    out = df.join(small_side(isotonic_cells(blocks, label)), _cell(p) == F.col("_cell"), "left")
    out = out.withColumn("_b", F.aggregate("_blocks", F.get("_blocks", F.lit(0)), lambda acc, x: F.when(x["lo"] <= p, x).otherwise(acc)))
    b = F.col("_b")
    line = b["value"] + (p - b["hi"]) / (b["next_lo"] - b["hi"]) * (b["next_value"] - b["value"])
    value = F.when((p <= b["hi"]) | b["next_lo"].isNull(), b["value"]).otherwise(line)
    return out.withColumn(output, F.when(p.isNotNull(), F.coalesce(value, p))).drop("_b", "_blocks", "_cell")


def apply_isotonic(scored: DataFrame, blocks: DataFrame, n_classes: int, proba: str = "proba", output: str = "proba_calibrated") -> DataFrame:
    """Calibrate each class, then rescale rows to sum 1; all-zero rows keep the raw probabilities."""
    out = scored
    for c in range(n_classes):
        out = with_isotonic(out, blocks, c, F.element_at(proba, c + 1), f"_c{c}")
    parts = [f"_c{c}" for c in range(n_classes)]
    out = out.withColumn("_raw", F.array(*[F.col(p) for p in parts]))
    return out.withColumn(output, renormalised(F.col("_raw"), F.col(proba))).drop("_raw", *parts)


def calibration_verdict(validation: DataFrame, n_classes: int, key: str = "member_id", bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """Fit on one half of validation, compare on the other; test rows are never involved.

    Returns the before/after table with the recommendation and the fitted blocks.
    """
    half = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(2))
    fit_rows, check_rows = validation.where(half == 0), validation.where(half == 1)
    blocks = fit_isotonic(fit_rows, n_classes)
    before = overall_summary(check_rows, bins)
    calibrated = apply_isotonic(check_rows, blocks, n_classes).withColumn("proba", F.col("proba_calibrated")).drop("proba_calibrated")
    after = overall_summary(calibrated, bins)
    improved = after["mean_ece"] < before["mean_ece"] and after["mean_brier"] - before["mean_brier"] <= 1e-6
    rows = [(m, float(before[m]), float(after[m]), float(after[m] - before[m]), "use_calibrated" if improved else "use_raw") for m in before]
    report = validation.sparkSession.createDataFrame(rows, "metric string, before double, after double, change double, recommendation string")
    return report, blocks
