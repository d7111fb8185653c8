import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberlens.operators import attribution, outputs, transitions
from memberlens.plans import scoring
from memberlens.sources import tables
from workload.adapter import MONTHS, raw_events, raw_members, raw_transactions

SMALL = "/root/testdata/sf0.001"
D = dt.datetime


def test_csv_keeps_empty_text_apart_from_null(frame, spark, tmp_path):
    path = str(tmp_path / "csv")
    tables.write_csv(frame([("A", ""), ("B", None), ("C", " x ")], "member_id string, reason string"), path)
    schema = T.StructType([T.StructField("member_id", T.StringType()), T.StructField("reason", T.StringType())])
    assert {r.member_id: r.reason for r in tables.scan_csv(spark, path, schema).collect()} == {"A": "", "B": None, "C": " x "}


def test_monthly_sink_replaces_only_its_dates(frame, spark, tmp_path):
    path = str(tmp_path / "monthly")
    schema = "member_id string, observation_date timestamp, v int"
    tables.write_monthly(frame([("A", D(2025, 1, 1), 1), ("A", D(2025, 2, 1), 2)], schema), path)
    tables.write_monthly(frame([("A", D(2025, 2, 1), 9)], schema), path)
    assert sorted(r.v for r in tables.read_monthly(spark, path).collect()) == [1, 9]
    assert tables.built_dates(spark, path) == {"2025-01-01", "2025-02-01"}
    calls = []

    def build(dates):
        calls.append(dates)
        return frame([("A", D.fromisoformat(d), 7) for d in dates], schema)

    # the first two months have no marker: nobody says that they are whole
    out = tables.build_missing(spark, path, ["2025-02-01"], build)
    assert calls == [["2025-02-01"]] and [r.v for r in out.collect()] == [7]
    out = tables.build_missing(spark, path, ["2025-02-01", "2025-03-01"], build)
    assert calls[1:] == [["2025-03-01"]] and sorted(r.v for r in out.collect()) == [7, 7]


def test_stale_and_half_written_months_are_built_again(frame, spark, tmp_path):
    path, source = str(tmp_path / "monthly"), tmp_path / "input.txt"
    source.write_text("one")
    schema = "member_id string, observation_date timestamp, v int"
    calls = []

    def build(dates):
        calls.append(list(dates))
        return frame([("A", D.fromisoformat(d), len(calls)) for d in dates], schema)

    def get(*dates):
        return sorted(r.v for r in tables.build_missing(spark, path, dates, build, [str(source)]).collect())

    months = ("2025-01-01", "2025-02-01")
    assert get(*months) == [1, 1] and get(*months) == [1, 1] and len(calls) == 1
    source.write_text("another input")
    assert get(*months) == [2, 2] and calls[1] == list(months)

    def killed(dates):
        calls.append(list(dates))
        tables.write_monthly(frame([("A", D.fromisoformat(d), 99) for d in dates], schema), path)
        raise RuntimeError("killed")

    source.write_text("a third input, longer")
    with pytest.raises(RuntimeError):
        tables.build_missing(spark, path, months, killed, [str(source)])
    assert get(*months) == [4, 4]
    # a file that came later, or one that is lost, makes a month suspect
    tables.write_monthly(frame([("B", D(2025, 2, 1), 50)], schema), path)
    assert get(*months) == [4, 5] and calls[-1] == ["2025-02-01"]


def test_prior_month_clamps():
    assert tables.prior_month("2025-12-31") == "2025-11-30" and tables.prior_month("2025-03-31") == "2025-02-28"


def test_pairs_need_consecutive_months(frame):
    cols = ["spend_total_30d"]
    rows = [("A", D(2025, m, 1), float(m), m % 3, 1) for m in (1, 2, 3, 5, 6)] + [("B", D(2025, 2, 1), 1.0, 0, 1)]
    panel = frame(rows, "member_id string, observation_date timestamp, spend_total_30d double, segment_id int, state_id int")
    free = transitions.build_pairs(panel, cols, use_lag=False)
    assert sorted((r.month_num, r.seg_curr, r.seg_next, r.pair_str) for r in free.collect()) == [(1, 1, 2, "Jan->Feb"), (2, 2, 0, "Feb->Mar"), (5, 2, 0, "May->Jun")]
    lagged = transitions.build_pairs(panel, cols, lag_columns=cols).collect()
    assert [(r.month_num, r.d_spend_total_30d, r.seg_prev, r.seg_changed) for r in lagged] == [(2, 1.0, 1.0, 1)]


def test_cohort_ranks_by_value_with_fallback(frame):
    rows = [("A", "s", [0.9, 0.1], 0, 5.0), ("B", "s", [0.2, 0.8], 0, 1.0), ("C", "t", [0.5, 0.5], 1, 9.0)]
    df = frame(rows, "member_id string, segment_name string, proba array<double>, seg_curr int, value_at_risk double")
    assert [r.member_id for r in outputs.cohort_members(outputs.cohort(df, segment_name="s")).collect()] == ["A", "B"]
    assert [r.member_id for r in outputs.cohort_members(outputs.cohort(df.drop("value_at_risk"), segment_name="s")).collect()] == ["B", "A"]
    total = outputs.cohort_totals(outputs.cohort(df, segment_name="s")).first()
    assert (total.matched, total.cohort_value_at_risk) == (2, 6.0)
    assert outputs.cohort_totals(outputs.cohort(df, segment_name="none")).first().matched == 0


def test_review_sample_covers_every_group(spark):
    df = spark.range(900).select(F.concat(F.lit("M"), F.col("id")).alias("member_id"), F.when(F.col("id") < 600, "big").otherwise("small").alias("segment_name"),
                                 (F.col("id") % 3).cast("string").alias("state_name"), F.col("id").cast("double").alias("value_at_risk"))
    out = outputs.review_sample(df, members=60).collect()
    assert len({r.member_id for r in out}) == len(out) == 60
    top = [r for r in out if (r.segment_name, r.state_name, r.picked_by) == ("big", "0", "value")]
    assert sorted(r.value_at_risk for r in top) == [585.0, 588.0, 591.0, 594.0, 597.0]


def test_whole_run(spark, tmp_path):
    """Panel, training and scoring on the smallest tables, with contracts and additive attribution."""
    members, txns, events = raw_members(spark, SMALL), raw_transactions(spark, SMALL), raw_events(spark, SMALL)
    spine, clean_txns, clean_events = scoring.conformed(members, txns, events, ["event_no"])
    panel = scoring.feature_panel(members, spine, clean_txns, clean_events, MONTHS)
    assert panel.count() == spine.count() * len(MONTHS)
    segments, model = scoring.train(panel, MONTHS[3], k=3, n_init=2)
    out = scoring.score(members, txns, events, "2024-02-01", segments, model, str(tmp_path / "out"), ["event_no"])
    assert all(df.count() == spine.count() for name, df in out.items() if name != "segment_profiles")
    assert out["segment_profiles"].count() == 3
    with pytest.raises(AssertionError):
        outputs.require_contract(outputs.contract_check(out["segment_assignments"].limit(3), spine, outputs.segment_rules(["S01", "S02", "S03"])))
    before = segments.identity()
    one = panel.where(F.col("observation_date") == F.lit(MONTHS[3]).cast("timestamp"))
    assert scoring.check_drift(one, one, segments, segments.columns).first().verdict == "HEALTHY" and segments.identity() == before
    with pytest.raises(RuntimeError):
        scoring.check_drift(one, one.withColumn("spend_total_30d", F.col("spend_total_30d") * 5 + 100), segments, segments.columns)
    scored = model.predict(transitions.build_pairs(segments.assign(panel), segments.columns))
    explained = attribution.contributions(scored, model, attribution.feature_means(scored, model.columns), F.col("seg_pred"))
    attribution.assert_additive(explained, 1e-6)
    text = attribution.top_drivers(explained, model.columns).first().evidence
    assert text.count(";") == 2 and ("raises" in text or "lowers" in text)


def test_walk_forward_keeps_every_eligible_month(frame):
    rows = [("A", D(2025, m, 1), float(m), m % 3, 1) for m in range(1, 8)]
    panel = frame(rows, "member_id string, observation_date timestamp, spend_total_30d double, segment_id int, state_id int")
    pairs = transitions.build_pairs(panel, ["spend_total_30d"], lag_columns=["spend_total_30d"])
    # January has no prior month, July no following one
    assert {r.month_num: r.split for r in transitions.walk_forward(pairs).collect()} == {2: "train", 3: "train", 4: "train", 5: "validation", 6: "test"}
    assert {r.split for r in transitions.walk_forward(pairs.where("month_num = 3")).collect()} == {"test"}


def test_month_end_panels_pair_in_both_directions(frame):
    ends = [D(2024, 9, 30), D(2024, 10, 31), D(2024, 11, 30), D(2024, 12, 31)]
    panel = frame([("A", d, float(i), i % 3, 1) for i, d in enumerate(ends)], "member_id string, observation_date timestamp, spend_total_30d double, segment_id int, state_id int")
    pairs = transitions.build_pairs(panel, ["spend_total_30d"], lag_columns=["spend_total_30d"]).collect()
    assert sorted((r.month_num, r.d_spend_total_30d, r.seg_prev, r.seg_next) for r in pairs) == [(10, 1.0, 0.0, 2), (11, 1.0, 1.0, 0)]


def test_importance_does_not_depend_on_units(spark):
    rows = spark.range(400).selectExpr("concat('M', id) AS member_id", "cast((id * 37) % 101 as double) AS a", "cast((id * 53) % 17 as double) AS b",
                                       "cast((id * 37) % 101 > 50 as int) AS seg_next")
    importance = {}
    for unit in (1.0, 100.0):
        scaled = rows.withColumn("a", F.col("a") * unit)
        importance[unit] = dict(transitions._fit(scaled, ["a", "b"], 2, (), "linear").importances())
    assert importance[1.0]["a"] > importance[1.0]["b"]
    assert importance[1.0] == pytest.approx(importance[100.0], rel=0.02)


def test_fits_with_several_penalties_assemble_their_rows_once(spark, monkeypatch):
    rows = spark.range(300).selectExpr("concat('M', id) AS member_id", "cast((id * 37) % 101 as double) AS a", "cast((id * 53) % 17 as double) AS b",
                                       "cast((id * 29) % 100 > 70 as int) AS seg_next")
    assembled, made = transitions.model_matrix, []
    monkeypatch.setattr(transitions, "model_matrix", lambda *args, **kwargs: made.append(kwargs.get("keep")) or assembled(*args, **kwargs))
    monkeypatch.setattr(transitions, "ROWS_HELD", 300)
    fits = transitions.weak_class_fits(rows, rows, ["a", "b"], 2)
    assert len(fits) == 2 and sum(keep is not None for keep in made) == 1


def test_score_and_training_panel_agree_on_the_previous_month(spark):
    members, txns, events = raw_members(spark, SMALL), raw_transactions(spark, SMALL), raw_events(spark, SMALL)
    spine, txns, events = scoring.conformed(members, txns, events, ["event_no"])
    date = MONTHS[4]
    short = scoring.feature_panel(members, spine, txns, events, [tables.prior_month(tables.prior_month(date)), tables.prior_month(date), date])
    long = scoring.feature_panel(members, spine, txns, events, MONTHS)
    before = F.col("observation_date") == F.lit(MONTHS[3]).cast("timestamp")
    pick = lambda p: sorted(map(tuple, p.where(before).select("member_id", "spend_acceleration").collect()))
    assert pick(short) == pick(long)


def test_facts_of_unknown_ids_do_not_reach_contact_rates(spark, frame):
    from memberlens.operators import contact

    members = raw_members(spark, SMALL)
    spine, _, events = scoring.conformed(members, raw_transactions(spark, SMALL), raw_events(spark, SMALL), ["event_no"])
    assert events.join(spine, "member_id", "left_anti").isEmpty()
    history = contact.contact_history(events, MONTHS[-1])
    assert history.join(spine, "member_id", "left_anti").isEmpty()


def test_segment_profiles_rank_every_feature(spark):
    import json
    import statistics

    from memberlens.operators.features import BEHAVIOURAL_FEATURES
    from memberlens.session import configure
    from workload import q_outputs
    from workload.catalog import QUERIES

    configure(spark)
    rows = q_outputs._combined(spark, SMALL).select("segment_id", *BEHAVIOURAL_FEATURES).collect()
    z = {}
    for c in BEHAVIOURAL_FEATURES:
        known = [(r.segment_id, float(r[c])) for r in rows if r[c] is not None]
        if not known:
            continue
        every = [v for _, v in known]
        spread = (statistics.stdev(every) if len(every) > 1 else 0.0) or 1.0
        for s in {s for s, _ in known}:
            z[s, c] = abs(statistics.fmean(v for k, v in known if k == s) - statistics.fmean(every)) / spread
    found = {r.segment_id: [t["feature"] for t in json.loads(r.key_characteristics)] for r in QUERIES["segment_profiles"](spark, SMALL).collect() if r.key_characteristics}
    assert set(found) == {s for s, _ in z}
    for s, best in found.items():
        assert [z[s, c] for c in best] == pytest.approx(sorted((x for (k, _), x in z.items() if k == s), reverse=True)[:5])


def test_contract_is_checked_in_the_write(frame, spark, tmp_path):
    path, schema = str(tmp_path / "out"), "member_id string, segment_id string, segment_confidence double"
    rules = outputs.segment_rules(["S01", "S02"])
    good = frame([("A", "S01", 0.5), ("B", "S02", 1.0)], schema)
    assert outputs.write_checked(good, path, 2, rules) == {"n_rows": 2, "bad_confidence": 0, "bad_segment_id": 0}
    for rows, n in (([("A", "S03", 0.5), ("B", "S02", None)], 2), ([("A", "S01", 0.5)], 2), ([], 1)):
        with pytest.raises(AssertionError):
            outputs.write_checked(frame(rows, schema), path, n, rules)
    assert sorted(r.member_id for r in spark.read.option("header", True).csv(path).collect()) == ["A", "B"]
    outputs.write_checked(frame([("C", "S01", 0.1)], schema), path, 1, rules)
    assert [r.member_id for r in spark.read.option("header", True).csv(path).collect()] == ["C"]


def test_boosting_stops_when_validation_no_longer_improves(spark):
    rows = spark.range(300).selectExpr("concat('M', id) AS member_id", "cast((id * 37) % 101 as double) AS a", "cast(xxhash64(id) % 1000 as double) AS noise",
                                       "cast((id * 37) % 101 > 50 as int) AS seg_next", "cast(pmod(xxhash64(id, 5), 2) as int) AS chance")
    train, validation = rows.where("member_id < 'M2'"), rows.where("member_id >= 'M2'")
    model = transitions.fit_boosted(train, validation, ["a", "noise"], 2, max_trees=8)
    scored = model.predict(validation).collect()
    assert all(abs(sum(r.proba) - 1) < 1e-9 for r in scored) and sum((r.proba[1] > 0.5) == (r.seg_next == 1) for r in scored) > 0.9 * len(scored)
    useless = transitions.fit_boosted(train.drop("seg_next").withColumnRenamed("chance", "seg_next"), validation.drop("seg_next").withColumnRenamed("chance", "seg_next"), ["a", "noise"], 2, max_trees=8)
    assert all(kept < 8 and most == 8 for kept, most in useless.stops)


def test_penalties_share_passes_and_reach_the_minimum(spark, monkeypatch):
    """Three penalties and other class weights: as many passes as the slowest fit needs, and Spark's coefficients at the minimum."""
    import numpy as np
    from pyspark.ml.classification import LogisticRegression

    from memberlens.operators import softmax
    from memberlens.operators.metrics import balanced_weights

    # a feature far from 0, a constant one, and a class (1) without rows
    rows = spark.range(1500).selectExpr(
        "concat('M', id) AS member_id", "cast((id * 37) % 101 as double) AS a", "cast((id * 53) % 17 as double) * 1000 + 5e5 AS b", "7.0D AS c", "cast(pmod(xxhash64(id), 1000) as double) AS d",
        "cast(case when (id * 37) % 101 > 70 then 2 when pmod(xxhash64(id), 1000) > 600 then 0 else 3 end as int) AS seg_next")
    columns, strengths, passes, summed = ["a", "b", "c", "d"], (1e-3, 1e-2, 1e-1), [], softmax._summed
    monkeypatch.setattr(softmax, "_summed", lambda *args: passes.append(args[1]) or summed(*args))
    held = transitions.fit_rows(rows, columns, 4)
    for boost, most in (((), 20), ((2,), 15)):
        passes.clear()
        models = transitions._linear(held, columns, boost, strengths)
        assert len(passes) <= most
        weighted = balanced_weights(held.vectors, "seg_next", boost).withColumn("seg_next", F.col("seg_next").cast("double"))
        spark_model = LogisticRegression(featuresCol="_features", labelCol="seg_next", weightCol="weight", family="multinomial", maxIter=2000, tol=1e-13, regParam=strengths[1]).fit(weighted)
        present = [0, 2, 3]
        assert models[1].classifier.coefficientMatrix.toArray()[present] == pytest.approx(spark_model.coefficientMatrix.toArray()[present], abs=1e-5)
        intercepts = spark_model.interceptVector.toArray()[present]
        assert models[1].classifier.interceptVector.toArray()[present] == pytest.approx(intercepts - intercepts.mean(), abs=1e-2)
    scored = models[1].predict(rows).collect()
    assert all(abs(sum(r.proba) - 1) < 1e-9 and r.proba[1] < 1e-9 and r.seg_pred == int(np.argmax(r.proba)) for r in scored)
    with pytest.raises(KeyError):
        models[1].predict(rows.drop("d"))
