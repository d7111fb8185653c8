"""Transition prediction, decision rules, calibration and campaign economics."""

from __future__ import annotations

from pyspark.sql import functions as F

from memberlens.functions import exprs
from memberlens.functions.scalars import beside
from memberlens.operators import attribution, calibration, economics, features, metrics, segments, transitions
from memberlens.operators.features import BEHAVIOURAL_FEATURES
from memberlens.session import cut_lineage
from workload import stages
from workload.adapter import MONTHS, N_CLASSES, SEGMENT_NAMES
from workload.oracle import div, half_even
from workload.oracle import query as sql
from workload.q_states import fit_columns, segment_model
from workload.registry import big, query, r6, rounded, when

K = range(N_CLASSES)

# --- pairs ---------------------------------------------------------------------------------------

_FEATURES = BEHAVIOURAL_FEATURES
_PAIRED = [*_FEATURES, *[f"d_{c}" for c in features.DELTA_COLUMNS]]


@query("transition_pairs", sql(
    f"SELECT c.member_id, {when('c.observation_date', 'observation_date')}, " + ", ".join(r6(half_even(f"coalesce(CAST(c.{c} AS DOUBLE), 0)", 6), c) for c in _FEATURES) + ", "
    + ", ".join(r6(half_even(f"coalesce(CAST(c.{c} AS DOUBLE), 0) - coalesce(CAST(p.{c} AS DOUBLE), 0)", 6), f"d_{c}") for c in features.DELTA_COLUMNS)
    + ", c.segment_id AS seg_curr, n.segment_id AS seg_next, CAST(c.state_id AS BIGINT) AS y_curr, "
    "CAST(p.segment_id AS DOUBLE) AS seg_prev, CAST(p.segment_id <> c.segment_id AS BIGINT) AS seg_changed, CAST(month(c.observation_date) AS INTEGER) AS month_num, "
    "strftime(c.observation_date, '%b') || '->' || strftime(n.observation_date, '%b') AS pair_str FROM states c "
    "JOIN states n ON n.member_id = c.member_id AND n.observation_date = c.observation_date + INTERVAL 1 MONTH "
    "JOIN states p ON p.member_id = c.member_id AND p.observation_date = c.observation_date - INTERVAL 1 MONTH"))
def _(spark, sf):
    pairs = transitions.build_pairs(stages.panel(spark, sf), _FEATURES)
    return rounded(pairs.select("member_id", "observation_date", *[exprs.half_even(F.col(c).cast("double"), 6).alias(c) for c in _PAIRED], "seg_curr", "seg_next", "y_curr",
                                "seg_prev", "seg_changed", "month_num", "pair_str"))


@query("walk_forward_split", sql(
    "SELECT month_num, CASE WHEN month_num BETWEEN 2 AND 9 THEN 'train' WHEN month_num = 10 THEN 'validation' WHEN month_num = 11 THEN 'test' ELSE 'none' END AS split, count(*) AS n_pairs "
    "FROM (SELECT CAST(month(c.observation_date) AS INTEGER) AS month_num FROM states c JOIN states n ON n.member_id = c.member_id AND n.observation_date = c.observation_date + INTERVAL 1 MONTH) GROUP BY 1, 2"))
def _(spark, sf):
    pairs = transitions.with_split(transitions.build_pairs(stages.panel(spark, sf), _FEATURES, use_lag=False))
    return pairs.groupBy("month_num", F.coalesce("split", F.lit("none")).alias("split")).agg(F.count(F.lit(1)).alias("n_pairs"))


@query("pair_month_split", sql(
    "SELECT strftime(c.observation_date, '%Y-%m-%d') AS pair_month, CASE dense_rank() OVER (ORDER BY c.observation_date DESC) WHEN 1 THEN 'test' WHEN 2 THEN 'validation' ELSE 'train' END AS split, count(*) AS n_pairs "
    "FROM states c JOIN states n ON n.member_id = c.member_id AND n.observation_date = c.observation_date + INTERVAL 1 MONTH "
    "JOIN states p ON p.member_id = c.member_id AND p.observation_date = c.observation_date - INTERVAL 1 MONTH GROUP BY c.observation_date"))
def _(spark, sf):
    """Part of every month that pairs with a prior month can be built for."""
    pairs = transitions.walk_forward(transitions.build_pairs(stages.panel(spark, sf), _FEATURES))
    return pairs.groupBy(F.date_format("observation_date", "yyyy-MM-dd").alias("pair_month"), "split").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("balanced_class_weights", sql(
    "SELECT seg_next, n_rows, " + r6("sum(n_rows) OVER () / (count(*) OVER () * CAST(n_rows AS DOUBLE)) * CASE WHEN seg_next = 3 THEN 2 ELSE 1 END", "weight")
    + " FROM (SELECT seg_next, count(*) AS n_rows FROM scored GROUP BY 1)"))
def _(spark, sf):
    weighted = metrics.balanced_weights(stages.scored(spark, sf), "seg_next", boost=[3])
    return rounded(weighted.groupBy("seg_next").agg(F.count(F.lit(1)).alias("n_rows"), F.max("weight").alias("weight")))


# --- model -----------------------------------------------------------------------------------------

def _labelled(spark, sf):
    """The panel with the segments of the frozen model; its pairs are stored once, then split by the months they have."""
    def build():
        model = segment_model(spark, sf)
        panel = stages.panel(spark, sf).drop("segment_id", "segment_name")
        assigned = model.assign(panel).select(*panel.columns, "segment_id")
        return transitions.build_pairs(assigned, fit_columns(panel))

    key = (spark.sparkContext.applicationId, str(sf))
    if key not in _split:
        _split[key] = transitions.walk_forward(stages.stored(spark, sf, "pairs", build))
    return _split[key]


_split: dict = {}
_trained: dict = {}


def transition_model(spark, sf):
    key = (spark.sparkContext.applicationId, str(sf))
    if key not in _trained:
        pairs = _labelled(spark, sf)
        columns = transitions.model_columns(fit_columns(stages.panel(spark, sf)))
        _trained[key] = transitions.train_transition_model(pairs.where("split = 'train'"), pairs.where("split = 'validation'"), columns, N_CLASSES)
    return _trained[key]


def _scored_test(spark, sf):
    return stages.stored(spark, sf, "scored_test", lambda: transition_model(spark, sf).predict(_labelled(spark, sf).where("split = 'test'")))


@query("transition_model")
def _(spark, sf):
    """Model against 'nobody moves' and the majority class on the test month."""
    train = _labelled(spark, sf).where("split = 'train'")
    return rounded(metrics.baselines(train, _scored_test(spark, sf)))


@query("transition_probabilities")
def _(spark, sf):
    scored = _scored_test(spark, sf)
    return rounded(scored.select("member_id", "seg_curr", "seg_pred", *[F.element_at("proba", c + 1).alias(f"p{c}") for c in K]))


@query("weak_class_boost")
def _(spark, sf):
    """Per-class F1 on validation with balanced and with boosted weights, and which of the two was kept."""
    pairs = _labelled(spark, sf)
    columns = transitions.model_columns(fit_columns(stages.panel(spark, sf)))
    return rounded(transitions.boost_report(pairs.where("split = 'train'"), pairs.where("split = 'validation'"), columns, N_CLASSES))


@query("feature_importance")
def _(spark, sf):
    ranked = transition_model(spark, sf).importances()
    return rounded(spark.createDataFrame([(i + 1, f, v) for i, (f, v) in enumerate(ranked)], "rank int, feature string, importance double"))


@query("forest_transition_model")
def _(spark, sf):
    """The same task with a random forest."""
    pairs = _labelled(spark, sf)
    columns = transitions.model_columns(fit_columns(stages.panel(spark, sf)))
    model = transitions.train_transition_model(pairs.where("split = 'train'"), pairs.where("split = 'validation'"), columns, N_CLASSES, kind="forest")
    return rounded(metrics.macro_f1(model.predict(pairs.where("split = 'test'")), "seg_next", "seg_pred"))


@query("boosted_transition_model")
def _(spark, sf):
    """The same task with boosted trees per class, each stopped when the validation month no longer improves."""
    pairs = _labelled(spark, sf)
    columns = transitions.model_columns(fit_columns(stages.panel(spark, sf)))
    model = transitions.fit_boosted(pairs.where("split = 'train'"), pairs.where("split = 'validation'"), columns, N_CLASSES)
    f1 = metrics.macro_f1(metrics.with_decision(model.predict(pairs.where("split = 'test'"))), "seg_next", "seg_pred")
    stops = spark.createDataFrame([(c, m, t) for c, (m, t) in enumerate(model.stops)], "label int, n_trees int, most_trees int")
    return rounded(beside(stops, f1.select("macro_f1")))


@query("parameter_search")
def _(spark, sf):
    pairs = _labelled(spark, sf)
    columns = transitions.model_columns(fit_columns(stages.panel(spark, sf)))
    table, _ = transitions.parameter_search(pairs.where("split = 'train'"), pairs.where("split = 'validation'"), columns, N_CLASSES,
                                            {"regParam": (1e-4, 1e-3, 1e-2, 1e-1), "elasticNetParam": (0.0, 0.5)})
    return rounded(table)


@query("downstream_segmentation_check")
def _(spark, sf):
    """The shipped segmentation against one with fewer segments, over all features."""
    model = segment_model(spark, sf)
    panel = stages.panel(spark, sf).drop("segment_id", "segment_name")
    fewer = segments.fit_segments(stages.month(panel, MONTHS[3]), fit_columns(panel), k=N_CLASSES - 1, fit_date=MONTHS[3])
    return rounded(transitions.downstream_check(panel, {"shipped": model, "fewer segments": fewer}, fit_columns(panel)))


@query("linear_attribution")
def _(spark, sf):
    """Top drivers of every test member's predicted class."""
    model, scored = transition_model(spark, sf), _scored_test(spark, sf)
    means = attribution.feature_means(scored, model.columns)
    explained = attribution.contributions(scored, model, means, F.col("seg_pred"))
    attribution.assert_additive(explained)
    return attribution.top_drivers(explained, model.columns).select("member_id", "seg_pred", "evidence")


@query("global_attribution")
def _(spark, sf):
    model, scored = transition_model(spark, sf), _scored_test(spark, sf)
    means = attribution.feature_means(scored, model.columns)
    return rounded(attribution.global_attribution(scored, model, means).select("feature", "overall", "strongest_class"))


# --- metrics on given probabilities -------------------------------------------------------------------

_CELLS = "SELECT seg_next AS y, list_position(proba, list_max(proba)) - 1 AS p, count(*) AS n FROM scored GROUP BY 1, 2"
_REPORT = (f"SELECT CAST(label AS BIGINT) AS label, {div('hits', 'called')} AS precision, {div('hits', 'support')} AS recall, {div('2 * hits', 'called + support')} AS f1, "
           "CAST(support AS BIGINT) AS support FROM (SELECT label, coalesce(sum(n) FILTER (WHERE y = label), 0) AS support, coalesce(sum(n) FILTER (WHERE p = label), 0) AS called, "
           "coalesce(sum(n) FILTER (WHERE y = label AND p = label), 0) AS hits FROM cells, range(5) r(label) GROUP BY 1 HAVING sum(n) FILTER (WHERE y = label OR p = label) > 0)")


def _decided(spark, sf):
    return metrics.with_decision(stages.scored(spark, sf))


@query("confusion_matrix", sql("SELECT CAST(y AS BIGINT) AS actual, CAST(p AS BIGINT) AS predicted, n FROM cells", cells=_CELLS))
def _(spark, sf):
    return metrics.confusion(_decided(spark, sf), "seg_next", "seg_pred")


@query("per_class_report", sql(f"SELECT label, {r6('precision', 'precision')}, {r6('recall', 'recall')}, {r6('f1', 'f1')}, support FROM report", cells=_CELLS, report=_REPORT))
def _(spark, sf):
    return rounded(metrics.class_report(metrics.confusion(_decided(spark, sf), "seg_next", "seg_pred")))


@query("classification_summary", sql(
    "SELECT " + ", ".join([r6("sum(recall * support) / sum(support)", "accuracy"), r6("avg(precision)", "macro_precision"), r6("avg(recall)", "macro_recall"), r6("avg(f1)", "macro_f1"),
                           r6("sum(precision * support) / sum(support)", "weighted_precision"), r6("sum(recall * support) / sum(support)", "weighted_recall"),
                           r6("sum(f1 * support) / sum(support)", "weighted_f1"), big("sum(support)", "support")]) + " FROM report", cells=_CELLS, report=_REPORT))
def _(spark, sf):
    return rounded(metrics.summary_rows(metrics.confusion(_decided(spark, sf), "seg_next", "seg_pred")))


_THETA = (0.3, 0.2, 0.25, 0.35, 0.15)


@query("threshold_ratio_decision", sql(
    f"SELECT seg_pred, count(*) AS n_rows FROM (SELECT CAST(list_position(q, list_max(q)) - 1 AS INTEGER) AS seg_pred FROM (SELECT [{', '.join(f'proba[{i + 1}] / ({t}e0 + 1e-9)' for i, t in enumerate(_THETA))}] AS q FROM scored)) GROUP BY 1"))
def _(spark, sf):
    return metrics.with_decision(stages.scored(spark, sf), _THETA).groupBy("seg_pred").agg(F.count(F.lit(1)).alias("n_rows"))


_GRID = "SELECT i AS place, 0.01e0 + i * (0.94e0 / 99) AS t FROM range(100) r(i)"
_EACH = "SELECT seg_next AS y, generate_subscripts(proba, 1) - 1 AS label, unnest(proba) AS p FROM scored"


@query("threshold_f1_curves", sql(
    f"SELECT CAST(label AS INTEGER) AS label, {r6('t', 'threshold')}, {r6(div('2 * count(*) FILTER (WHERE p >= t AND y = label)', 'count(*) FILTER (WHERE p >= t) + count(*) FILTER (WHERE y = label)'), 'f1')} "
    "FROM each_class, grid GROUP BY label, t", each_class=_EACH, grid=_GRID))
def _(spark, sf):
    return rounded(metrics.threshold_curves(stages.scored(spark, sf), N_CLASSES))


@query("best_class_thresholds", sql(
    f"SELECT CAST(label AS INTEGER) AS label, {r6('CASE WHEN f1 > 0 THEN t ELSE 0.5 END', 'threshold')}, {r6('f1', 'f1')} FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, t) AS rn FROM "
    f"(SELECT label, t, {div('2 * count(*) FILTER (WHERE p >= t AND y = label)', 'count(*) FILTER (WHERE p >= t) + count(*) FILTER (WHERE y = label)')} AS f1 FROM each_class, grid GROUP BY label, t)) WHERE rn = 1",
    each_class=_EACH, grid=_GRID))
def _(spark, sf):
    return rounded(metrics.best_thresholds(metrics.threshold_curves(stages.scored(spark, sf), N_CLASSES)))


def _f1_of(prediction: str, where: str) -> str:
    return (f"(SELECT avg({div('2 * hits', 'called + support')}) FROM (SELECT label, count(*) FILTER (WHERE y = label) AS support, count(*) FILTER (WHERE p = label) AS called, "
            f"count(*) FILTER (WHERE y = label AND p = label) AS hits FROM (SELECT seg_next AS y, {prediction} AS p FROM scored WHERE {where}), range(5) r(label) GROUP BY 1) WHERE called + support > 0)")


_ARGMAX = "list_position(proba, list_max(proba)) - 1"
_RATIO = "list_position(list_transform(proba, lambda x, i: x / ([0.3e0, 0.2e0, 0.25e0, 0.35e0, 0.15e0][i] + 1e-9)), list_max(list_transform(proba, lambda x, i: x / ([0.3e0, 0.2e0, 0.25e0, 0.35e0, 0.15e0][i] + 1e-9)))) - 1"


@query("decision_rule_choice", sql(
    f"SELECT {r6('a', 'argmax_f1')}, {r6('t', 'threshold_f1')}, CASE WHEN t > a THEN 'threshold' ELSE 'argmax' END AS rule FROM (SELECT {_f1_of(_ARGMAX, 'split = $$validation$$')} AS a, {_f1_of(_RATIO, 'split = $$validation$$')} AS t)"))
def _(spark, sf):
    return rounded(metrics.choose_rule(stages.scored(spark, sf).where("split = 'validation'"), _THETA))


_MAJORITY = "(SELECT seg_next FROM (SELECT seg_next, count(*) AS n FROM scored WHERE split = $$validation$$ GROUP BY 1) ORDER BY n DESC, seg_next LIMIT 1)"


@query("majority_and_persistence_baselines", sql(
    f"SELECT method, {r6('f', 'macro_f1')}, {r6('(SELECT max(f) FILTER (WHERE method = $$model$$) FROM b) - f', 'model_lift')} FROM b",
    b=f"SELECT 'majority' AS method, {_f1_of(_MAJORITY, 'split = $$test$$')} AS f UNION ALL SELECT 'persistence', {_f1_of('seg_curr', 'split = $$test$$')} UNION ALL SELECT 'model', {_f1_of(_ARGMAX, 'split = $$test$$')}"))
def _(spark, sf):
    rows = _decided(spark, sf)
    return rounded(metrics.baselines(rows.where("split = 'validation'"), rows.where("split = 'test'")))


@query("bootstrap_interval")
def _(spark, sf):
    return rounded(metrics.bootstrap_macro_f1(_decided(spark, sf), "seg_next", "seg_pred"))


_NAMED = "CASE {c} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(SEGMENT_NAMES)) + " END"


@query("scored_test_table", sql(
    f"SELECT {_NAMED.format(c='seg_curr')} AS seg_curr_name, {_NAMED.format(c='seg_next')} AS seg_next_name, {_NAMED.format(c='p')} AS seg_pred_name, {big('sum(CAST(seg_next = p AS INTEGER))', 'n_correct')}, count(*) AS n_rows "
    f"FROM (SELECT *, {_ARGMAX} AS p FROM scored WHERE split = 'test') GROUP BY 1, 2, 3"))
def _(spark, sf):
    out = metrics.scored_table(stages.scored(spark, sf).where("split = 'test'"), SEGMENT_NAMES)
    return out.groupBy("seg_curr_name", "seg_next_name", "seg_pred_name").agg(F.sum("correct").alias("n_correct"), F.count(F.lit(1)).alias("n_rows"))


@query("stratified_subsample", sql("SELECT seg_next, CAST(floor(5000 * count(*) / CAST((SELECT count(*) FROM scored) AS DOUBLE)) AS BIGINT) AS n_rows FROM scored GROUP BY 1"))
def _(spark, sf):
    """Exact class counts of a 5000-row sample."""
    return metrics.stratified_sample(stages.scored(spark, sf), "seg_next", 5000).groupBy("seg_next").agg(F.count(F.lit(1)).alias("n_rows"))


# --- calibration -------------------------------------------------------------------------------------

_BINS = ("SELECT label, least(floor(p * 15), 14) AS bin, count(*) AS n, avg(p) AS mean_p, avg(CAST(y = label AS INTEGER)) AS rate FROM each_class GROUP BY 1, 2")


def _outcomes(spark, sf):
    return calibration.per_class(stages.scored(spark, sf))


@query("expected_calibration_error", sql(f"SELECT CAST(label AS INTEGER) AS label, {r6('sum(abs(mean_p - rate) * n) / sum(n)', 'ece')} FROM bins GROUP BY 1", each_class=_EACH, bins=_BINS))
def _(spark, sf):
    return rounded(calibration.expected_calibration_error(_outcomes(spark, sf)))


@query("maximum_calibration_error", sql(f"SELECT CAST(label AS INTEGER) AS label, {r6('coalesce(max(abs(mean_p - rate)) FILTER (WHERE n >= 50), 0)', 'mce')} FROM bins GROUP BY 1", each_class=_EACH, bins=_BINS))
def _(spark, sf):
    return rounded(calibration.maximum_calibration_error(_outcomes(spark, sf)))


@query("reliability_curve", sql(
    f"SELECT CAST(label AS INTEGER) AS label, {r6('bin / 15', 'bin_lo')}, {r6('(bin + 1) / 15', 'bin_hi')}, n, {r6('mean_p', 'mean_predicted')}, {r6('rate', 'observed_rate')}, {r6('mean_p - rate', 'gap')} FROM bins",
    each_class=_EACH, bins=_BINS))
def _(spark, sf):
    return rounded(calibration.reliability_curve(_outcomes(spark, sf)))


@query("brier_scores", sql(f"SELECT CAST(label AS INTEGER) AS label, {r6('avg((p - CAST(y = label AS INTEGER)) * (p - CAST(y = label AS INTEGER)))', 'brier')}, {r6('avg(p)', 'mean_predicted')}, "
                           f"{r6('avg(CAST(y = label AS INTEGER))', 'base_rate')} FROM each_class GROUP BY 1", each_class=_EACH))
def _(spark, sf):
    return rounded(calibration.brier_scores(_outcomes(spark, sf)))


@query("multiclass_log_loss", sql(f"SELECT {r6('avg(-ln(least(1, greatest(proba[seg_next + 1], 1e-9))))', 'log_loss')} FROM scored"))
def _(spark, sf):
    return rounded(calibration.log_loss(stages.scored(spark, sf)))


@query("isotonic_calibration")
def _(spark, sf):
    scored = stages.scored(spark, sf)
    blocks = calibration.fit_isotonic(scored.where("split = 'validation'"), N_CLASSES)
    out = calibration.apply_isotonic(scored.where("split = 'test'"), blocks, N_CLASSES)
    return rounded(out.groupBy("seg_curr").agg(*[F.avg(F.element_at("proba_calibrated", c + 1)).alias(f"p{c}") for c in K]))


_CUT = "[" + ", ".join(f"CASE WHEN proba[{i + 1}] > 0.3 OR seg_curr = 1 THEN 0e0 ELSE proba[{i + 1}] END" for i in K) + "]"


@query("renormalised_rows", sql(
    f"SELECT member_id, {', '.join(r6(f'CASE WHEN s <= 1e-12 THEN proba[{i + 1}] ELSE q[{i + 1}] / s END', f'p{i}') for i in K)} FROM (SELECT *, list_sum(q) AS s FROM (SELECT member_id, proba, {_CUT} AS q FROM scored))"))
def _(spark, sf):
    """Rows with entries zeroed, some entirely, brought back to sum 1; dead rows use the original."""
    from memberlens.functions.vectors import renormalised

    cut = F.transform("proba", lambda p: F.when((p > 0.3) | (F.col("seg_curr") == 1), F.lit(0.0)).otherwise(p))
    fixed = renormalised(F.col("_cut"), F.col("proba"))
    out = stages.scored(spark, sf).withColumn("_cut", cut).withColumn("_p", fixed)
    return rounded(out.select("member_id", *[F.element_at("_p", i + 1).alias(f"p{i}") for i in K]))


@query("calibration_verdict")
def _(spark, sf):
    report, _ = calibration.calibration_verdict(cut_lineage(stages.scored(spark, sf).where("split = 'validation'")), N_CLASSES)
    return rounded(report)


# --- economics -------------------------------------------------------------------------------------------

_VALUES = "SELECT list(coalesce(v, 0) ORDER BY k) AS v FROM (SELECT k, (SELECT avg(spend_total_180d) FROM scored WHERE split = 'validation' AND seg_curr = k) AS v FROM range(5) r(k))"
_TERM = "proba[{i}] * greatest(0, v[seg_curr + 1] - v[{i}])"
_RISK = ("SELECT member_id, split, seg_curr, seg_next, proba, " + " + ".join(_TERM.format(i=i + 1) for i in K) + " AS var, "
         + " + ".join(f"CASE WHEN v[{i + 1}] < v[seg_curr + 1] THEN proba[{i + 1}] ELSE 0 END" for i in K)
         + " AS adv, greatest(0, v[seg_curr + 1] - v[seg_next + 1]) AS loss, v[seg_next + 1] < v[seg_curr + 1] AS adverse FROM scored, vals")
_WITH = {"vals": _VALUES, "risk": _RISK}


def _risk(spark, sf):
    """Scored rows with risk columns; segment values come from validation rows only."""
    scored = stages.scored(spark, sf)
    values = economics.collect_values(economics.segment_values(scored.where("split = 'validation'"), N_CLASSES))
    return economics.with_risk(scored, values)


def _stored_risk(spark, sf):
    return stages.stored(spark, sf, "risk", lambda: _risk(spark, sf))


@query("segment_values", sql(f"SELECT k AS seg_curr, {r6('v[k + 1]', 'segment_value')} FROM vals, range(5) r(k)", **_WITH))
def _(spark, sf):
    return rounded(economics.segment_values(stages.scored(spark, sf).where("split = 'validation'"), N_CLASSES))


@query("value_at_risk", sql(f"SELECT member_id, {r6('var', 'value_at_risk')} FROM risk", **_WITH))
def _(spark, sf):
    return rounded(_risk(spark, sf).select("member_id", "value_at_risk"))


@query("adverse_probability", sql(f"SELECT member_id, {r6('adv', 'adverse_probability')} FROM risk", **_WITH))
def _(spark, sf):
    return rounded(_risk(spark, sf).select("member_id", "adverse_probability"))


@query("realised_loss", sql(f"SELECT member_id, {r6('loss', 'realised_loss')}, adverse AS actually_adverse FROM risk", **_WITH))
def _(spark, sf):
    return rounded(_risk(spark, sf).select("member_id", "realised_loss", "actually_adverse"))


def _campaign(contact: str, cost: str = "5e0", rate: str = "0.1e0", where: str = "split = 'test'") -> str:
    return (f"SELECT count(*) FILTER (WHERE c) AS contacted, {r6(div('count(*) FILTER (WHERE c)', 'count(*)'), 'contact_rate')}, {r6(f'count(*) FILTER (WHERE c) * {cost}', 'cost')}, "
            f"{r6(f'coalesce(sum(loss) FILTER (WHERE c AND adverse), 0) * {rate}', 'recovered', 4)}, {r6(f'coalesce(sum(loss) FILTER (WHERE c AND adverse), 0) * {rate} - count(*) FILTER (WHERE c) * {cost}', 'profit', 4)}, "
            f"{r6(div(f'coalesce(sum(loss) FILTER (WHERE c AND adverse), 0) * {rate} - count(*) FILTER (WHERE c) * {cost}', f'count(*) FILTER (WHERE c) * {cost}'), 'roi')}, "
            f"{r6(div('count(*) FILTER (WHERE c AND adverse)', 'count(*) FILTER (WHERE c)'), 'precision')}, {r6(div('count(*) FILTER (WHERE c AND adverse)', 'count(*) FILTER (WHERE adverse)'), 'recall')} "
            f"FROM (SELECT *, {contact} AS c FROM risk WHERE {where})")


def _money(df):
    return rounded(df.withColumns({c: F.round(c, 4) for c in ("recovered", "profit") if c in df.columns}))


@query("probability_policy", sql(_campaign("adv >= 0.5e0"), **_WITH))
def _(spark, sf):
    return _money(economics.evaluate_campaign(_stored_risk(spark, sf).where("split = 'test'"), economics.contact_by_probability(0.5)))


@query("expected_value_policy", sql(_campaign("var * 0.1e0 >= 5e0 * 7e0"), **_WITH))
def _(spark, sf):
    return _money(economics.evaluate_campaign(_stored_risk(spark, sf).where("split = 'test'"), economics.contact_by_value(k=7.0)))


_POINTS = "SELECT (i + 1) / 100e0 AS t FROM range(99) r(i)"
_KPOINTS = "SELECT (i + 1) / 10e0 AS t FROM range(50) r(i) UNION ALL SELECT 5.5e0 + i * (40e0 - 5.5e0) / 39 FROM range(40) r(i)"


def _sweep(condition: str, rate: str = "0.1e0", where: str = "split = 'validation'") -> str:
    return (f"SELECT t, count(*) FILTER (WHERE {condition}) AS contacted, count(*) FILTER (WHERE ({condition}) AND adverse) AS hits, count(*) FILTER (WHERE adverse) AS adv_n, "
            f"coalesce(sum(loss) FILTER (WHERE ({condition}) AND adverse), 0) * {rate} - count(*) FILTER (WHERE {condition}) * 5e0 AS profit FROM risk, pts WHERE {where} GROUP BY t")


@query("probability_sweep", sql(f"SELECT {r6('t', 'threshold')}, contacted, {r6('profit', 'profit', 4)}, {r6(div('2 * hits', 'contacted + adv_n'), 'f1')} FROM sw",
                                pts=_POINTS, sw=_sweep("adv >= t"), **_WITH))
def _(spark, sf):
    swept = economics.probability_sweep(_stored_risk(spark, sf).where("split = 'validation'"))
    return _money(swept.select("threshold", "contacted", "profit", "f1"))


@query("expected_value_sweep", sql(f"SELECT {r6('t', 'threshold')}, contacted, {r6('profit', 'profit', 4)} FROM sw", pts=_KPOINTS, sw=_sweep("var * 0.1e0 >= 5e0 * t"), **_WITH))
def _(spark, sf):
    swept = economics.value_sweep(_stored_risk(spark, sf).where("split = 'validation'"))
    return _money(swept.select("threshold", "contacted", "profit"))


_BEST = "(SELECT arg_max(t, (round({by}, 6), -t)) FROM {sw})"


@query("operating_points", sql(
    " UNION ALL ".join(f"SELECT '{n}' AS policy, {r6(t, 'threshold')}, * FROM ({_campaign(c)})" for n, t, c in (
        ("contact_everyone", "0", "true"),
        ("f1_optimal", _BEST.format(by=div("2 * hits", "contacted + adv_n"), sw="sp"), f"adv >= {_BEST.format(by=div('2 * hits', 'contacted + adv_n'), sw='sp')}"),
        ("best_probability", _BEST.format(by="profit", sw="sp"), f"adv >= {_BEST.format(by='profit', sw='sp')}"),
        ("ev_optimal", _BEST.format(by="profit", sw="sk"), f"var * 0.1e0 >= 5e0 * {_BEST.format(by='profit', sw='sk')}"))),
    sp=_sweep("adv >= t").replace("pts", "ppts"), sk=_sweep("var * 0.1e0 >= 5e0 * t").replace("pts", "kpts"), ppts=_POINTS, kpts=_KPOINTS, **_WITH))
def _(spark, sf):
    risk = _stored_risk(spark, sf)
    return _money(economics.choose_and_apply(risk.where("split = 'validation'"), risk.where("split = 'test'")))


def _sensitivity_sql() -> str:
    rates = ("0.02", "0.05", "0.1", "0.2", "0.3")
    parts, extra = [], {}
    for i, r in enumerate(rates):
        extra[f"sr{i}"] = _sweep(f"var * {r}e0 >= 5e0 * t", f"{r}e0")
        best = _BEST.format(by="profit", sw=f"sr{i}")
        parts.append(f"SELECT {r6(r, 'recovery_rate')}, {r6(best, 'threshold')}, * FROM ({_campaign(f'var * {r}e0 >= 5e0 * {best}', rate=f'{r}e0')})")
    return sql(" UNION ALL ".join(parts), pts=_KPOINTS, **extra, **_WITH)


@query("recovery_rate_sensitivity", _sensitivity_sql())
def _(spark, sf):
    risk = _stored_risk(spark, sf)
    return _money(economics.recovery_sensitivity(risk.where("split = 'validation'"), risk.where("split = 'test'")))


_LEVELS = ("SELECT *, lag(level) OVER (ORDER BY level) AS earlier, coalesce(sum(n) OVER u, 0) AS n0, coalesce(sum(loss) OVER u, 0) AS l0 FROM (SELECT level, sum(n) AS n, sum(loss) AS loss FROM "
           "(SELECT 5e0 * 1e0 / var AS level, 1 AS n, CASE WHEN adverse THEN loss ELSE 0 END AS loss FROM risk WHERE split = 'test' AND var > 0 AND 5e0 * 1e0 / var <= 1 UNION ALL SELECT 1e0, 0, 0e0) GROUP BY level) "
           "WINDOW u AS (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")


@query("break_even_recovery_rates", sql(
    f"SELECT {r6('rate', 'recovery_rate')}, {big('contacted', 'contacted')}, {r6('profit', 'profit', 4)}, CASE WHEN gains THEN 'becomes_profitable' ELSE 'becomes_unprofitable' END AS change FROM "
    "(SELECT n0 * 5e0 / l0 AS rate, n0 AS contacted, 0e0 AS profit, true AS gains FROM levels WHERE l0 > 0 AND l0 * level - n0 * 5e0 > 0 AND l0 * earlier - n0 * 5e0 <= 0 "
    "UNION ALL SELECT level, n0 + n, (l0 + loss) * level - (n0 + n) * 5e0, (l0 + loss) * level - (n0 + n) * 5e0 > 0 FROM levels WHERE (l0 * level - n0 * 5e0 > 0) <> ((l0 + loss) * level - (n0 + n) * 5e0 > 0))",
    **_WITH, levels=_LEVELS))
def _(spark, sf):
    return _money(economics.break_even_rates(_stored_risk(spark, sf).where("split = 'test'")))
