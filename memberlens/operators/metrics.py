"""Classification metrics from confusion counts, baselines, weights and resampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.functions.exprs import count_where, ratio
from memberlens.functions.scalars import beside
from memberlens.functions.vectors import argmax, array_lit, element
from memberlens.session import small_side

# Grid of the per-class threshold search.
THRESHOLD_GRID = tuple(0.01 + i * (0.94 / 99) for i in range(100))
WEAK_F1 = 0.75
WEAK_BOOST = 2.0


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).cast("long").alias("actual"), F.col(predicted).cast("long").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def class_report(confused: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as actual or predicted; 0 where undefined."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    # each cell counts once for its actual and once for its predicted class
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hits")))
    per_class = (confused.select(F.explode(sides).alias("s")).select("s.*").groupBy("label")
                 .agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hits").alias("hits")))
    return per_class.select(
        "label", ratio(F.col("hits"), F.col("called")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("called") + F.col("support")).alias("f1"), "support")


def summary_rows(confused: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted averages."""
    report = class_report(confused)
    n = F.col("support")

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * n) / F.sum(n)

    return report.agg(
        weighted("recall").alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), weighted("precision").alias("weighted_precision"), weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"), F.sum(n).alias("support"))


def macro_f1(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return class_report(confusion(df, actual, predicted)).agg(F.avg("f1").alias("macro_f1"))


# --- decision rules ------------------------------------------------------------------

def ratio_decision(thresholds: Sequence[float], proba: str = "proba") -> Column:
    """Class with the largest probability relative to its threshold."""
    return argmax(F.zip_with(proba, array_lit(thresholds), lambda p, t: p / (t + F.lit(1e-9))))


def threshold_curves(df: DataFrame, n_classes: int, actual: str = "seg_next", proba: str = "proba",
                     grid: Sequence[float] = THRESHOLD_GRID) -> DataFrame:
    """One-against-rest F1 of every class at every grid threshold, from one pass over the rows."""
    points = [float(g) for g in grid]

    def reached(p: Column, low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(p >= F.lit(points[middle]), reached(p, middle + 1, high)).otherwise(reached(p, low, middle))

    each = df.select(F.col(actual).alias("_y"), F.posexplode(proba).alias("label", "_p"))
    level = each.groupBy("label", reached(F.col("_p"), 0, len(points)).alias("_level")).agg(
        F.count(F.lit(1)).alias("_c"), count_where(F.col("_y") == F.col("label")).alias("_h"))
    # n_classes x grid rows from here on
    steps = df.sparkSession.range(0, n_classes * (len(points) + 1)).select(
        F.floor(F.col("id") / (len(points) + 1)).cast("int").alias("label"), (F.col("id") % (len(points) + 1)).cast("int").alias("_level"))
    full = steps.join(level, ["label", "_level"], "left").na.fill(0, ["_c", "_h"])
    down = Window.partitionBy("label").orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, 0)
    summed = full.select("label", "_level", F.sum("_c").over(down).alias("called"), F.sum("_h").over(down).alias("hits"),
                         F.sum("_h").over(Window.partitionBy("label")).alias("support"))
    return summed.where(F.col("_level") > 0).select(
        "label", F.element_at(array_lit(points), F.col("_level")).alias("threshold"),
        ratio(2 * F.col("hits"), F.col("called") + F.col("support")).alias("f1"))


def best_thresholds(curves: DataFrame) -> DataFrame:
    """Per class, the lowest threshold with the highest F1; 0.5 where no threshold scores."""
    best = curves.groupBy("label").agg(F.max(F.struct("f1", -F.col("threshold"))).alias("_b"))
    scored = F.col("_b.f1") > 0
    return best.select("label", F.when(scored, -F.col("_b.col2")).otherwise(F.lit(0.5)).alias("threshold"), F.col("_b.f1").alias("f1"))


def choose_rule(validation: DataFrame, thresholds: Sequence[float], actual: str = "seg_next", proba: str = "proba") -> DataFrame:
    """Macro F1 of plain argmax and of the threshold rule on validation; the latter must be strictly better."""
    pred = validation.withColumns({"_plain": argmax(F.col(proba)), "_ratio": ratio_decision(thresholds, proba)})
    plain = macro_f1(pred, actual, "_plain").select(F.col("macro_f1").alias("argmax_f1"))
    calibrated = macro_f1(pred, actual, "_ratio").select(F.col("macro_f1").alias("threshold_f1"))
    return beside(plain, calibrated).withColumn(
        "rule", F.when(F.col("threshold_f1") > F.col("argmax_f1"), "threshold").otherwise("argmax"))


# --- weights and baselines -------------------------------------------------------------

def balanced_weights(df: DataFrame, label: str, boost: Sequence[int] = (), factor: float = WEAK_BOOST, output: str = "weight") -> DataFrame:
    """Weight n / (K n_c) per row, times `factor` for the boosted classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    one = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    table = beside(counts, one).select(
        label, (F.col("_n") / (F.col("_k") * F.col("_nc"))
                * F.when(F.col(label).isin([int(b) for b in boost]), F.lit(float(factor))).otherwise(F.lit(1.0))).alias(output))
    return df.join(small_side(table), label)  # one row per class


def weak_classes(report: DataFrame, below: float = WEAK_F1) -> list[int]:
    return [int(r.label) for r in report.where(F.col("f1") < below).orderBy("label").collect()]


def majority_class(train: DataFrame, label: str) -> DataFrame:
    """Most frequent class, the lowest id on ties."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min(F.struct(-F.col("n"), F.col(label).alias("label"))).alias("_m")).select(F.col("_m.label").alias("label"))


def baselines(train: DataFrame, test: DataFrame, actual: str = "seg_next", current: str = "seg_curr",
              predicted: str = "seg_pred") -> DataFrame:
    """Macro F1 of the majority class, of 'nobody moves' and of the model, with the model's lift."""
    majority = majority_class(train, actual).select(F.col("label").alias("_majority"))
    rows = beside(test, majority)
    parts = [macro_f1(rows, actual, c).select(F.lit(name).alias("method"), "macro_f1")
             for name, c in (("majority", "_majority"), ("persistence", current), ("model", predicted))]
    table = parts[0].union(parts[1]).union(parts[2])
    model = F.max(F.when(F.col("method") == "model", F.col("macro_f1"))).over(Window.partitionBy(F.lit(1)))  # three rows
    return table.withColumn("model_lift", model - F.col("macro_f1"))


# --- resampling ---------------------------------------------------------------------------

def bootstrap_macro_f1(df: DataFrame, actual: str, predicted: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile interval of macro F1.

    Resampling rows with replacement is a multinomial draw over the confusion
    cells, so only the K x K counts are resampled, one draw per resample.
    """
    import numpy as np

    cells = confusion(df, actual, predicted).orderBy("actual", "predicted").collect()  # K x K rows
    labels = sorted({c.actual for c in cells} | {c.predicted for c in cells})
    at = {label: i for i, label in enumerate(labels)}
    place = np.array([(at[c.actual], at[c.predicted]) for c in cells], dtype=int).reshape(-1, 2)
    counts = np.array([c.n for c in cells], dtype=float)

    def draw(batches: Iterator) -> Iterator:
        for batch in batches:
            scores = []
            for b in batch["id"]:
                taken = np.random.default_rng([seed, int(b)]).multinomial(int(counts.sum()), counts / counts.sum())
                matrix = np.zeros((len(labels), len(labels)))
                np.add.at(matrix, (place[:, 0], place[:, 1]), taken)
                hits, size = np.diag(matrix), matrix.sum(axis=0) + matrix.sum(axis=1)
                # classes absent from a resample are not part of its average
                scores.append(float((2 * hits[size > 0] / size[size > 0]).mean()))
            batch["macro_f1"] = scores
            yield batch

    drawn = df.sparkSession.range(resamples).mapInPandas(draw, "id long, macro_f1 double")
    return drawn.agg(F.count(F.lit(1)).alias("resamples"), F.percentile("macro_f1", F.lit(0.025)).alias("ci_low"),
                     F.percentile("macro_f1", F.lit(0.975)).alias("ci_high"), F.avg("macro_f1").alias("mean_f1"))


def stratified_sample(df: DataFrame, strata: str, size: int, key: str = "member_id", seed: int = 42, minimum: int = 0) -> DataFrame:
    """Proportional sample of about `size` rows with an exact, repeatable count per stratum.

    Rows are ordered by a hash of their key. A hash limit slightly above the
    wanted share removes almost everything first, so only about as many rows as
    will be kept are ever sorted.
    """
    counts = {r[strata]: r.n for r in df.groupBy(strata).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values()) or 1
    wanted = {s: min(n, max(minimum, size * n // total)) for s, n in counts.items()}
    space = 1 << 30
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(space))

    def per_stratum(value) -> Column:
        pairs = [F.struct(F.lit(s).alias("k"), F.lit(value(s)).cast("long").alias("v")) for s in counts]
        return F.map_from_entries(F.array(*pairs))[F.col(strata)]

    def limit(s) -> int:
        return int(space * min(1.0, (wanted[s] + 8 * wanted[s] ** 0.5 + 20) / counts[s])) + 1

    near = df.withColumn("_place", place).where(F.col("_place") < per_stratum(limit))
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(strata).orderBy("_place", key)))
    return ranked.where(F.col("_rank") <= per_stratum(lambda s: wanted[s])).drop("_place", "_rank")


def with_decision(df: DataFrame, thresholds: Sequence[float] | None = None, proba: str = "proba", output: str = "seg_pred") -> DataFrame:
    """Predicted class by the stored rule: thresholds if given, plain argmax otherwise."""
    rule = ratio_decision(thresholds, proba) if thresholds is not None else argmax(F.col(proba))
    return df.withColumn(output, rule)


def scored_table(df: DataFrame, names: Sequence[str], thresholds: Sequence[float] | None = None) -> DataFrame:
    """Predictions with segment names and a correct flag."""
    table = F.array(*[F.lit(n) for n in names])
    out = with_decision(df, thresholds)
    return out.withColumns({
        **{f"{c}_name": element(table, F.col(c)) for c in ("seg_curr", "seg_next", "seg_pred")},
        "correct": (F.col("seg_next") == F.col("seg_pred")).cast("long")})
