import numpy as np
import pytest
from pyspark.sql import functions as F

from memberlens.functions.vectors import argmax, renormalised
from memberlens.operators import calibration, economics, metrics

VALUES = (1000.0, 500.0, 100.0)


def test_segment_values_fill_unseen(frame):
    df = frame([(0, 10.0), (0, 30.0), (2, 5.0)], "seg_curr int, spend_total_180d double")
    assert economics.collect_values(economics.segment_values(df, 3)) == [20.0, 0.0, 5.0]


def test_value_at_risk_by_hand(frame):
    df = frame([([0.5, 0.3, 0.2], 0, 2), ([0.5, 0.3, 0.2], 2, 0), ([0.1, 0.6, 0.3], 1, 1)], "proba array<double>, seg_curr int, seg_next int")
    out = economics.with_risk(df, VALUES).collect()
    assert [r.value_at_risk for r in out] == pytest.approx([0.3 * 500 + 0.2 * 900, 0.0, 0.3 * 400])
    assert [r.adverse_probability for r in out] == pytest.approx([0.5, 0.0, 0.3])
    assert [(r.realised_loss, r.actually_adverse) for r in out] == [(900.0, True), (0.0, False), (0.0, False)]


def _cases(frame):
    rows = [(1.0, 100.0, True, 1000.0), (0.6, 300.0, False, 0.0), (0.5, 20.0, True, 500.0), (0.1, 0.0, False, 0.0)]
    return frame(rows, "adverse_probability double, value_at_risk double, actually_adverse boolean, realised_loss double")


def test_campaign_credits_only_adverse_members(frame):
    r = economics.evaluate_campaign(_cases(frame), economics.contact_by_probability(0.5), cost=5.0, rate=0.1).first()
    assert (r.contacted, r.cost, r.recovered, r.profit, r.roi) == (3, 15.0, 150.0, 135.0, 9.0)
    assert r.precision == pytest.approx(2 / 3) and r.recall == 1.0 and r.contact_rate == 0.75
    nobody = economics.evaluate_campaign(_cases(frame), F.lit(False)).first()
    assert (nobody.contacted, nobody.roi, nobody.precision) == (0, 0.0, 0.0)


def test_sweep_equals_single_evaluations(frame):
    cases = _cases(frame)
    swept = {round(r.threshold, 4): r for r in economics.probability_sweep(cases).collect()}
    assert len(swept) == 99
    for t in (0.01, 0.1, 0.11, 0.5, 0.51, 0.99):
        one = economics.evaluate_campaign(cases, economics.contact_by_probability(t)).first()
        assert (swept[t].contacted, swept[t].profit, swept[t].recall) == (one.contacted, pytest.approx(one.profit), one.recall)
    by_k = {round(r.threshold, 4): r.contacted for r in economics.value_sweep(cases).collect()}
    assert len(by_k) == 90 and (by_k[1.0], by_k[2.0], by_k[2.1], by_k[40.0]) == (2, 2, 1, 0)


def test_break_even_reports_every_change(frame):
    rows = [(100.0, True, 100.0)] + [(10.0, False, 0.0)] * 30
    df = frame(rows, "value_at_risk double, actually_adverse boolean, realised_loss double")
    found = [(r.recovery_rate, r.change) for r in economics.break_even_rates(df, cost=5.0).orderBy("recovery_rate").collect()]
    # one adverse case pays off above 5%; at 50% thirty useless contacts join and profit turns negative
    assert found == [(pytest.approx(0.05, abs=1e-9), "becomes_profitable"), (0.5, "becomes_unprofitable")]


@pytest.mark.parametrize("seed,share,changes", [(12, 0.25, 1), (3, 0.25, 5), (5, 0.15, 11), (8, 0.0, 0)])
def test_break_even_rates_equal_bisection(frame, seed, share, changes):
    rng = np.random.default_rng(seed)
    rows = [(float(v), bool(a), float(l)) for v, a, l in zip(rng.gamma(1.5, 40, 300), rng.random(300) < share, rng.gamma(1.2, 50, 300))] + [(0.0, True, 9.0), (-3.0, True, 9.0)]
    df = frame(rows, "value_at_risk double, actually_adverse boolean, realised_loss double")

    def profit(r):
        hit = [(a, l) for v, a, l in rows if v > 0 and 5.0 / v <= r]
        return sum(l for a, l in hit if a) * r - 5.0 * len(hit)

    expected = []
    levels = sorted({5.0 / v for v, _, _ in rows if v > 0 and 5.0 / v <= 1} | {1.0})
    for low, high in zip(levels, levels[1:]):
        a, b = low, np.nextafter(high, 0)
        if (profit(a) > 0) != (profit(b) > 0):
            while b - a > 1e-13:
                m = (a + b) / 2
                a, b = (m, b) if (profit(m) > 0) == (profit(a) > 0) else (a, m)
            expected.append(b)
        if (profit(np.nextafter(high, 0)) > 0) != (profit(high) > 0):
            expected.append(high)
    found = sorted(r.recovery_rate for r in economics.break_even_rates(df).collect())
    assert len(found) == changes and found == pytest.approx(expected, abs=1e-9)


def _outcomes(frame, pairs):
    return frame([(0, float(p), float(y)) for p, y in pairs], "label int, p double, y double")


def test_calibration_bins(frame):
    perfect = _outcomes(frame, [(1.0, 1), (1.0, 1), (0.0, 0)])
    assert calibration.expected_calibration_error(perfect).first().ece == 0.0
    bad = _outcomes(frame, [(1.0, 0)] * 4)
    assert calibration.expected_calibration_error(bad).first().ece == 1.0
    curve = calibration.reliability_curve(bad).collect()
    assert len(curve) == 1 and curve[0].bin_hi == 1.0
    assert calibration.maximum_calibration_error(bad).first().mce == 0.0
    assert calibration.maximum_calibration_error(bad, min_count=4).first().mce == 1.0
    assert calibration.expected_calibration_error(bad.limit(0)).count() == 0


def test_renormalise_dead_rows(frame):
    df = frame([([0.2, 0.2], [0.9, 0.1]), ([0.0, 0.0], [0.9, 0.1])], "a array<double>, b array<double>")
    assert [r.x for r in df.select(renormalised(F.col("a"), F.col("b")).alias("x")).collect()] == [[0.5, 0.5], [0.9, 0.1]]
    assert df.select(renormalised(F.col("a")).alias("x")).collect()[1].x == [0.5, 0.5]


@pytest.fixture
def scored(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([1, 1, 1], 400)
    y = [int(rng.choice(3, p=row)) for row in p]
    return p, y, spark.createDataFrame([(f"M{i}", [float(v) for v in row], y[i], i % 3) for i, row in enumerate(p)],
                                       "member_id string, proba array<double>, seg_next int, seg_curr int")


def _f1(y, pred, label):
    tp = sum(a == label and b == label for a, b in zip(y, pred))
    size = sum(a == label for a in y) + sum(b == label for b in pred)
    return 2 * tp / size if size else 0.0


def test_macro_f1_counts_predicted_only_classes(frame):
    df = frame([(0, 0), (0, 1), (2, 2), (2, 0)], "a int, b int")
    want = np.mean([_f1([0, 0, 2, 2], [0, 1, 2, 0], c) for c in (0, 1, 2)])
    assert metrics.macro_f1(df, "a", "b").first().macro_f1 == pytest.approx(want)


def test_threshold_search_equals_brute_force(scored):
    p, y, df = scored
    best = {r.label: (r.threshold, r.f1) for r in metrics.best_thresholds(metrics.threshold_curves(df, 3)).collect()}
    for c in range(3):
        want_t, want_f = 0.5, 0.0
        for t in np.linspace(0.01, 0.95, 100):
            f = _f1([int(v == c) for v in y], [int(v >= t) for v in p[:, c]], 1)
            if f > want_f:
                want_t, want_f = t, f
        assert best[c] == (pytest.approx(want_t), pytest.approx(want_f))


def test_bootstrap_covers_the_estimate(scored):
    _, _, df = scored
    pred = df.withColumn("seg_pred", argmax(F.col("proba")))
    point = metrics.macro_f1(pred, "seg_next", "seg_pred").first().macro_f1
    ci = metrics.bootstrap_macro_f1(pred, "seg_next", "seg_pred", resamples=300).first()
    assert ci.ci_low < point < ci.ci_high and ci.resamples == 300
    assert metrics.bootstrap_macro_f1(pred, "seg_next", "seg_pred", resamples=300).first() == ci


def test_isotonic_rows_sum_to_one(scored):
    _, _, df = scored
    blocks = calibration.fit_isotonic(df, 3)
    out = calibration.apply_isotonic(df, blocks, 3)
    assert out.where(F.abs(F.aggregate("proba_calibrated", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0
    assert calibration.expected_calibration_error(calibration.per_class(out, proba="proba_calibrated")).agg(F.max("ece")).first()[0] < 0.1


@pytest.mark.parametrize("ranges", [None, 1, 2, 9])
def test_isotonic_blocks_equal_the_library_fit(spark, scored, ranges):
    from pyspark.ml.regression import IsotonicRegression

    _, _, df = scored
    blocks = calibration.fit_isotonic(df, 3, ranges=ranges)
    probe = spark.range(0, 2001).select((F.col("id") / 2000.0).alias("x"))
    for c in range(3):
        points = df.groupBy(F.element_at("proba", c + 1).alias("p")).agg(F.avg((F.col("seg_next") == c).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
        library = IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w").fit(points).setFeaturesCol("x").setPredictionCol("v")
        expected = {r.x: r.v for r in library.transform(probe).collect()}
        found = {r.x: r.q for r in calibration.with_isotonic(probe, blocks, c, F.col("x"), "q").collect()}
        assert found == pytest.approx(expected, abs=1e-9) and len(set(found.values())) > 3
        rising = blocks.where(F.col("label") == c).orderBy("lo").collect()
        assert all(a.value < b.value and a.hi < b.lo and a.next_lo == b.lo and a.next_value == b.value for a, b in zip(rising, rising[1:]))


def test_isotonic_blocks_keep_the_mean_and_pool_across_ranges(spark):
    # falling hit rates: everything is one block, whatever the ranges
    rows = spark.range(0, 500).select(F.lit(0).alias("label"), (F.col("id") / 500.0).alias("p"), (500 - F.col("id")).cast("double").alias("hits"), F.lit(500.0).alias("weight"))
    for ranges in (1, 4, 7):
        b = calibration.pooled_blocks(rows, ranges).collect()
        assert [(x.lo, x.hi, x.hits, x.weight) for x in b] == [(0.0, 0.998, 125250.0, 250000.0)]


def test_isotonic_edges(spark, frame):
    blocks = calibration.fit_isotonic(frame([([0.2, 0.8], 0), ([0.6, 0.4], 0), ([None, 0.5], 1)], "proba array<double>, seg_next int"), 2)
    df = frame([(None,), (0.0,), (0.4,), (1.0,)], "p double")
    assert [r.q for r in calibration.with_isotonic(df, blocks, 0, F.col("p"), "q").collect()] == [None, 1.0, 1.0, 1.0]
    assert [r.q for r in calibration.with_isotonic(df, blocks, 7, F.col("p"), "q").collect()] == [None, 0.0, 0.4, 1.0]
    assert calibration.fit_isotonic(frame([], "proba array<double>, seg_next int"), 2).count() == 0


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(20000).select(F.concat(F.lit("M"), F.col("id")).alias("member_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("c"))
    a = metrics.stratified_sample(df, "c", 900)
    assert {r.c: r["count"] for r in a.groupBy("c").count().collect()} == {0: 599, 1: 300}
    assert a.join(metrics.stratified_sample(df.repartition(7), "c", 900), "member_id", "left_anti").count() == 0


def test_weights_balance_and_boost(frame):
    df = frame([(0,)] * 6 + [(1,)] * 2, "y int")
    out = {r.y: r.weight for r in metrics.balanced_weights(df, "y", boost=[1]).distinct().collect()}
    assert out == {0: pytest.approx(8 / 12), 1: pytest.approx(4.0)}
