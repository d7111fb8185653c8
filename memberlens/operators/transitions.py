"""Next-month segment moves: pairs, split, model, decision rule and evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from itertools import product

import numpy as np
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.functions.exprs import filled
from memberlens.functions.vectors import renormalised
from memberlens.operators import softmax
from memberlens.operators.calibration import mean_log_loss
from memberlens.operators.features import (
    DELTA_COLUMNS, SEGMENT_HISTORY_COLUMNS, VELOCITY_COLUMNS, add_panel_deltas, add_segment_history, add_velocity, model_matrix,
    next_value, prior_value)
from memberlens.operators.metrics import (
    WEAK_BOOST, balanced_weights, best_thresholds, choose_rule, class_report, confusion, macro_f1, stratified_sample, threshold_curves,
    weak_classes, with_decision)
from memberlens.operators.softmax import SoftmaxModel
from memberlens.session import cut_lineage, side_by_side

CONTEXT_COLUMNS = ("seg_curr", "y_curr", "month_num")
ROWS_HELD = 2_000_000  # of fits side by side that keep their rows in memory


def build_pairs(panel: DataFrame, feature_columns: Sequence[str], use_lag: bool = True, lag_columns: Sequence[str] = DELTA_COLUMNS,
                extra: Sequence[str] = ()) -> DataFrame:
    """One row per member and month with the segment of the following month.

    `panel` carries features, segment_id and state_id of every month. The
    neighbouring months are read with lag and lead over the member's rows, so
    all of them share one exchange instead of three self-joins.
    """
    panel = add_velocity(panel)
    if use_lag:
        panel = add_panel_deltas(panel, lag_columns)
    moved = panel.withColumns({
        "seg_next": next_value(F.col("segment_id")), "_prev": prior_value(F.col("segment_id")),
        "_has_prev": prior_value(F.lit(True)).isNotNull()})
    pairs = moved.where(F.col("seg_next").isNotNull() & F.col("segment_id").isNotNull() & F.col("state_id").isNotNull())
    if use_lag:
        # the changes need a stored prior month
        pairs = pairs.where(F.col("_has_prev"))
    pairs = pairs.withColumns({"seg_curr": F.col("segment_id"), "y_curr": F.col("state_id"), "month_num": F.month("observation_date")})
    keep = [*feature_columns, *VELOCITY_COLUMNS, *([f"d_{c}" for c in lag_columns] if use_lag else [])]
    if use_lag:
        pairs = add_segment_history(pairs, "_prev")
        keep += list(SEGMENT_HISTORY_COLUMNS)
    month = F.date_format("observation_date", "MMM")
    following = F.date_format(F.add_months(F.to_date("observation_date"), 1), "MMM")
    return pairs.na.fill(0, keep).select("member_id", "observation_date", *dict.fromkeys([*keep, *extra]), "seg_curr", "seg_next", "y_curr",
                                         "month_num", F.concat(month, F.lit("->"), following).alias("pair_str"))


def model_columns(feature_columns: Sequence[str], use_lag: bool = True, lag_columns: Sequence[str] = DELTA_COLUMNS) -> list[str]:
    lagged = [*[f"d_{c}" for c in lag_columns], *SEGMENT_HISTORY_COLUMNS] if use_lag else []
    return [*feature_columns, *VELOCITY_COLUMNS, *lagged, *CONTEXT_COLUMNS]


def with_split(pairs: DataFrame, train: Sequence[int] = tuple(range(2, 10)), validation: int = 10, test: int = 11) -> DataFrame:
    """Walk-forward split by month of the pair; other months belong to no part."""
    m = F.col("month_num")
    return pairs.withColumn("split", F.when(m.isin(list(train)), "train").when(m == validation, "validation").when(m == test, "test"))


def walk_forward(pairs: DataFrame) -> DataFrame:
    """The same split for a panel of any length: last month test, the one before validation, every earlier one train.

    Pairs that need a prior month lack the panel's first month already (`build_pairs`), so none is left out here.
    The months are collected at once: store the pairs before, or they are built for that alone.
    """
    months = [r.d for r in pairs.select(F.col("observation_date").alias("d")).distinct().orderBy(F.desc("d")).limit(2).collect()]
    day, split = F.col("observation_date"), F.lit("train")
    for month, part in zip(reversed(months), ("validation", "test")[-len(months):]):
        split = F.when(day == F.lit(month), part).otherwise(split)
    return pairs.withColumn("split", split)


@dataclass
class TransitionModel:
    """A probability model with the decision rule chosen for it."""

    columns: list[str]
    classifier: SoftmaxModel | LogisticRegressionModel | RandomForestClassificationModel
    n_classes: int
    thresholds: list[float] | None = None
    weighting: str = "balanced"
    deviations: list[float] | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds `proba` and `seg_pred` by the stored rule."""
        if isinstance(self.classifier, SoftmaxModel):
            return with_decision(df.withColumn("proba", self.classifier.probabilities(feature_array(df, self.columns))), self.thresholds)
        matrix = model_matrix(df, self.columns, "_features")
        scored = self.classifier.transform(matrix).withColumn("proba", vector_to_array(self.classifier.getProbabilityCol()))
        drop = ["_features", self.classifier.getRawPredictionCol(), self.classifier.getProbabilityCol(), self.classifier.getPredictionCol()]
        return with_decision(scored.drop(*drop), self.thresholds)

    def importances(self) -> list[tuple[str, float]]:
        """Features by importance: tree importances, or mean |coefficient x deviation| of the linear model."""
        if isinstance(self.classifier, RandomForestClassificationModel):
            values = self.classifier.featureImportances.toArray()
        else:
            values = np.abs(self.classifier.coefficientMatrix.toArray()).mean(axis=0) * np.asarray(self.deviations)
        return sorted(zip(self.columns, [float(v) for v in values]), key=lambda p: (-p[1], p[0]))


def feature_array(df: DataFrame, columns: Sequence[str]) -> Column:
    """The values of a feature vector as an array. Absent columns raise; null values become 0."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"feature column(s) absent: {absent}")
    return F.array(*[filled(c) for c in columns])


@dataclass
class FitRows:
    """Rows of a fit, assembled and stored once for all fits on them: as blocks for the linear fit, as vectors for those of Spark ML."""

    assembled: DataFrame
    n_classes: int
    #: the last model fitted on these rows, by penalty
    fitted: dict[float, SoftmaxModel] = field(default_factory=dict)

    @cached_property
    def vectors(self) -> DataFrame:
        return cut_lineage(self.assembled, fine=True)

    @cached_property
    def blocks(self) -> DataFrame:
        return softmax.blocks(self.assembled.select(F.col("seg_next").cast("int").alias("label"), vector_to_array("_features").alias("values")))

    @cached_property
    def moments(self) -> softmax.Moments:
        return softmax.moments(self.blocks, self.n_classes)

    @cached_property
    def deviations(self) -> list[float]:
        """Every feature's deviation over all rows."""
        return self.moments.weighted(np.ones(self.n_classes))[1].tolist()

    def class_weights(self, boost: Sequence[int]) -> list[float]:
        """What `balanced_weights` gives the rows of each class."""
        counts = self.moments.counts
        k = int((counts > 0).sum())
        return [float(counts.sum() / (k * n)) * (WEAK_BOOST if c in boost else 1.0) if n else 0.0 for c, n in enumerate(counts)]


def fit_rows(train: DataFrame, columns: Sequence[str], n_classes: int) -> FitRows:
    return FitRows(model_matrix(train, columns, "_features", keep=["seg_next"]), n_classes)


def _weighting(boost: Sequence[int]) -> str:
    return "balanced + weak-class boost" if boost else "balanced"


def _linear(rows: FitRows, columns: Sequence[str], boost: Sequence[int], strengths: Sequence[float]) -> list[TransitionModel]:
    """One fit per penalty, in the same passes. Fits under other weights, if there were any, are where these start."""
    start = [rows.fitted[s] for s in strengths] if all(s in rows.fitted for s in strengths) else None
    found = softmax.fit_many(rows.blocks, rows.moments, strengths, rows.class_weights(boost), start)
    rows.fitted.update(zip(strengths, found, strict=True))
    return [TransitionModel(list(columns), m, rows.n_classes, weighting=_weighting(boost), deviations=rows.deviations) for m in found]


def _fit(rows: FitRows | DataFrame, columns: Sequence[str], n_classes: int, boost: Sequence[int], kind: str, **params) -> TransitionModel:
    rows = rows if isinstance(rows, FitRows) else fit_rows(rows, columns, n_classes)
    if kind == "linear" and not params.get("elasticNetParam") and set(params) <= {"regParam", "elasticNetParam"}:
        return _linear(rows, columns, boost, [params.get("regParam", 1e-3)])[0]
    matrix = balanced_weights(rows.vectors, "seg_next", boost).withColumn("seg_next", F.col("seg_next").cast("double"))
    names = {"featuresCol": "_features", "labelCol": "seg_next", "weightCol": "weight", "rawPredictionCol": "_raw", "probabilityCol": "_prob",
             "predictionCol": "_pred"}
    if kind == "forest":
        estimator, deviations = RandomForestClassifier(**names, seed=42, **{"numTrees": 60, "maxDepth": 8, **params}), None
    else:
        estimator, deviations = LogisticRegression(**names, family="multinomial", **{"maxIter": 50, "regParam": 1e-3, **params}), rows.deviations
    return TransitionModel(list(columns), estimator.fit(matrix), n_classes, weighting=_weighting(boost), deviations=deviations)


def fit_regularised(rows: FitRows, validation: DataFrame, columns: Sequence[str], boost: Sequence[int] = (),
                    strengths: Sequence[float] = (1e-3, 1e-2, 1e-1)) -> TransitionModel:
    """Fit with several penalties and keep the one with the lowest validation log-loss.

    The validation month limits the model's complexity, as early stopping would. All penalties share the passes, over the rows and over the validation month.
    """
    models = _linear(rows, columns, boost, strengths)
    scored = validation.select("seg_next", feature_array(validation, columns).alias("_values"))
    scored = scored.select("seg_next", *[m.classifier.probabilities(F.col("_values")).alias(f"_p{i}") for i, m in enumerate(models)])
    losses = scored.agg(*[mean_log_loss(proba=f"_p{i}").alias(f"_{i}") for i in range(len(models))]).first()
    return min(zip(losses, models, strict=True), key=lambda found: found[0])[1]


@dataclass
class BoostedModel:
    """One ensemble of boosted trees per class; their probabilities are scaled to one row."""

    columns: list[str]
    classifiers: list[GBTClassificationModel]
    #: per class the trees that were kept, and the most that were allowed
    stops: list[tuple[int, int]]

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds `proba`."""
        out = model_matrix(df, self.columns, "_features")
        for c, model in enumerate(self.classifiers):
            margin, probability = model.getRawPredictionCol(), model.getProbabilityCol()
            out = model.transform(out).withColumn(f"_p{c}", vector_to_array(probability)[1]).drop(margin, probability, "_pred")
        parts = [f"_p{c}" for c in range(len(self.classifiers))]
        return out.withColumn("proba", renormalised(F.array(*[F.col(p) for p in parts]))).drop("_features", *parts)


def fit_boosted(train: DataFrame, validation: DataFrame, columns: Sequence[str], n_classes: int, max_trees: int = 20, depth: int = 3,
                rate: float = 0.3, tolerance: float = 0.01) -> BoostedModel:
    """Boosted trees for each class against the others, with balanced weights.

    The validation rows take no part in the fit: a class's boosting ends when the loss on them no longer falls by `tolerance`
    (relative to the loss, absolute below 0.01), and keeps the trees up to the best loss. Every fit keeps its rows in memory: fits of
    more than ROWS_HELD rows in all run one after another, since they would push each other to disk.
    """
    both = (balanced_weights(train, "seg_next").withColumn("_validation", F.lit(False))
            .unionByName(balanced_weights(validation, "seg_next").withColumn("_validation", F.lit(True))))
    matrix = cut_lineage(model_matrix(both, columns, "_features", keep=["seg_next", "weight", "_validation"]), fine=True)

    def fit(c: int) -> GBTClassificationModel:
        estimator = GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="weight", predictionCol="_pred",
                                  validationIndicatorCol="_validation", validationTol=tolerance, maxIter=max_trees, maxDepth=depth, stepSize=rate, seed=42)
        return estimator.fit(matrix.withColumn("_label", (F.col("seg_next") == c).cast("double")))

    models = side_by_side(fit, range(n_classes), min(4, max(1, ROWS_HELD // max(matrix.count(), 1))))
    return BoostedModel(list(columns), models, [(m.getNumTrees, max_trees) for m in models])


def _val_f1(model: TransitionModel, validation: DataFrame) -> float:
    return macro_f1(with_decision(model.predict(validation)), "seg_next", "seg_pred").first().macro_f1


def weak_class_fits(train: DataFrame, validation: DataFrame, columns: Sequence[str], n_classes: int, kind: str = "linear",
                    **params) -> list[tuple[TransitionModel, DataFrame, bool]]:
    """The balanced fit and, if it has weak classes, one with these boosted: model, per-class report on validation, whether it is kept.

    The boosted fit is kept only if its macro F1 on validation is higher.
    """
    rows = fit_rows(train, columns, n_classes)

    def fit(boost: Sequence[int]) -> tuple[TransitionModel, DataFrame]:
        if kind == "linear" and not params:
            model = fit_regularised(rows, validation, columns, boost)
        else:
            model = _fit(rows, columns, n_classes, boost, kind, **params)
        return model, cut_lineage(class_report(confusion(with_decision(model.predict(validation)), "seg_next", "seg_pred")))

    model, report = fit(())
    weak = weak_classes(report)
    if not weak:
        return [(model, report, True)]
    boosted, boosted_report = fit(weak)
    f1, boosted_f1 = (float(r.agg(F.avg("f1").alias("f1")).first().f1) for r in (report, boosted_report))
    better = boosted_f1 > f1
    return [(model, report, not better), (boosted, boosted_report, better)]


def boost_report(train: DataFrame, validation: DataFrame, columns: Sequence[str], n_classes: int, kind: str = "linear", **params) -> DataFrame:
    """Per-class F1 of every fit of `weak_class_fits`: weighting, kept, label, f1, support."""
    parts = [report.select(F.lit(model.weighting).alias("weighting"), F.lit(kept).alias("kept"), "label", "f1", "support")
             for model, report, kept in weak_class_fits(train, validation, columns, n_classes, kind, **params)]
    return reduce(DataFrame.unionByName, parts)


def train_transition_model(train: DataFrame, validation: DataFrame, columns: Sequence[str], n_classes: int,
                           kind: str = "linear", **params) -> TransitionModel:
    """Balanced weights, a boost of weak classes kept only if validation improves, and the rule picked on validation."""
    validation = cut_lineage(validation, fine=True)
    fits = weak_class_fits(train, validation, columns, n_classes, kind, **params)
    model = next(m for m, _, kept in fits if kept)
    scored = cut_lineage(model.predict(validation).select("member_id", "seg_next", "proba"))
    limits = {int(r.label): float(r.threshold) for r in best_thresholds(threshold_curves(scored, n_classes)).collect()}
    thresholds = [limits.get(c, 0.5) for c in range(n_classes)]
    if choose_rule(scored, thresholds).first().rule == "threshold":
        model.thresholds = thresholds
    return model


def parameter_search(train: DataFrame, validation: DataFrame, columns: Sequence[str], n_classes: int, grid: dict[str, Sequence],
                     sample_size: int = 200_000, kind: str = "linear") -> tuple[DataFrame, dict]:
    """Search on a stratified sample of at most about `sample_size` labelled rows, then refit baseline and best on all rows and compare them by the same rule."""
    small, whole = fit_rows(stratified_sample(train, "seg_next", sample_size), columns, n_classes), fit_rows(train, columns, n_classes)
    rows, best = [], None
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        score = _val_f1(_fit(small, columns, n_classes, (), kind, **params), validation)
        rows.append((str(params), float(score), "subsample"))
        if best is None or score > best[1]:
            best = (params, score)
    baseline = _val_f1(_fit(whole, columns, n_classes, (), kind), validation)
    tuned = _val_f1(_fit(whole, columns, n_classes, (), kind, **best[0]), validation)
    rows += [("baseline", float(baseline), "full"), (str(best[0]), float(tuned), "full")]
    accepted = best[0] if tuned > baseline else {}
    return train.sparkSession.createDataFrame(rows, "params string, macro_f1 double, data string"), accepted


def downstream_check(panel: DataFrame, candidates: dict, feature_columns: Sequence[str]) -> DataFrame:
    """Relabel the panel with each candidate segmentation, rebuild pairs, retrain and compare macro F1 on validation."""
    rows = []
    for name, model in candidates.items():
        labelled = model.assign(panel.drop("segment_id", "segment_name")).select(*[c for c in panel.columns if c != "segment_name"]
                                                                                  if "segment_id" in panel.columns else [*panel.columns, "segment_id"])
        pairs = walk_forward(cut_lineage(build_pairs(labelled, feature_columns), fine=True))
        train, validation = pairs.where("split = 'train'"), pairs.where("split = 'validation'")
        k = len(model.centroids)
        columns = model_columns(feature_columns)
        fitted = _fit(train, columns, k, (), "linear")
        stays = macro_f1(validation, "seg_next", "seg_curr").first().macro_f1
        rows.append((name, k, float(_val_f1(fitted, validation)), float(stays)))
    return panel.sparkSession.createDataFrame(rows, "candidate string, k int, macro_f1 double, persistence_f1 double").orderBy(F.desc("macro_f1"))
