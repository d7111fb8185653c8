import datetime as dt
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from memberlens.operators import features, snapshot, tier
from memberlens.session import cut_lineage

OBS = "2025-12-31"
D = dt.datetime


def _txn(frame, rows):
    return frame(rows, "transaction_id string, member_id string, transaction_date timestamp, transaction_amount double, transaction_type string, "
                       "channel string, merchant_category string, points_earned long, points_clawed_back long")


def _evt(frame, rows):
    return frame(rows, "member_id string, event_date timestamp, event_type string, session_duration_sec double")


def _members(frame, rows):
    return frame(rows, "member_id string, account_open_date timestamp, tier_history string")


def test_boundaries_of_windows(frame):
    members = _members(frame, [("A", D(2020, 1, 1), None), ("B", D(2025, 12, 1, 12), None), ("C", D(2026, 3, 1), None)])
    edge = D(2025, 12, 1)  # exactly 30 days before
    txns = _txn(frame, [
        ("1", "A", edge, 10.0, "purchase", "web", "c1", 5, 0), ("2", "A", edge - dt.timedelta(seconds=1), 20.0, "purchase", "app", "c2", 5, 3),
        ("3", "A", D(2025, 12, 31), 7.0, "return", "shop", "c1", 0, 0), ("4", "A", D(2025, 12, 31, 0, 0, 1), 99.0, "purchase", "web", "c9", 9, 9),
        ("5", "B", D(2025, 12, 1, 11), 50.0, "purchase", "web", "c1", 1, 0)])
    events = _evt(frame, [("A", D(2025, 12, 24), "app_open", 30.0), ("A", D(2025, 12, 23, 23), "app_open", None)])
    spine = members.select("member_id", "account_open_date")
    out = {r.member_id: r for r in snapshot.build_snapshots(spine, txns, events, members, [OBS]).collect()}
    a, b, c = out["A"], out["B"], out["C"]
    assert (a.spend_total_30d, a.purchase_count_30d, a.spend_total_90d, a.return_count_7d) == (10.0, 1, 30.0, 1)
    assert (a.unique_categories_90d, a.unique_channels_90d, a.app_open_7d, a.app_open_30d, a.total_session_sec_30d) == (2, 3, 1, 2, 30.0)
    # the return on the observation date itself is the last transaction of any type
    assert (a.recency_days, a.points_earned_lifetime, a.points_redeemed_lifetime, a.current_point_balance_reconstructed) == (0, 10, 3, 7)
    # before enrolment: nothing counts, but the trend input is not restricted
    assert (b.purchase_count_180d, b.recency_days, b.tenure_days) == (0, None, 29)
    assert c.tenure_days < 0 and c.spend_total_180d == 0


def test_many_dates_equal_single_dates(frame):
    random.seed(3)
    dates = ["2025-06-01", "2025-07-01", "2025-09-15", "2025-12-31"]
    ids = [f"M{i}" for i in range(12)]
    members = _members(frame, [(m, D(2025, 1, 1) + dt.timedelta(days=random.randrange(300)), None) for m in ids])
    moment = lambda: D(2024, 6, 1) + dt.timedelta(seconds=random.randrange(600 * 86400))
    owner = lambda: "M0" if random.random() < .4 else random.choice(ids)  # noqa: E731  (one hot member)
    txns = _txn(frame, [(str(i), owner(), moment(), float(random.randrange(100)), random.choice(["purchase", "return", "exchange"]), random.choice("ab"),
                         random.choice("xyz"), random.randrange(9), random.randrange(4)) for i in range(600)])
    events = _evt(frame, [(owner(), moment(), random.choice(snapshot.EVENT_TYPES), 5.0) for _ in range(400)])
    spine = members.select("member_id", "account_open_date")
    joint = snapshot.build_snapshots(spine, txns, events, members, dates)
    rows = {(r.member_id, r.observation_date): r for r in joint.collect()}
    assert len(rows) == len(ids) * len(dates)
    for d in dates:
        for r in snapshot.build_snapshots(spine, txns, events, members, [d]).select(joint.columns).collect():
            assert r == rows[(r.member_id, r.observation_date)]


def test_guards(frame):
    ok = frame([("A", D(2025, 12, 31), D(2025, 1, 1))], "member_id string, d timestamp, opened timestamp")
    late = frame([("A", D(2025, 12, 31, 1), D(2025, 1, 1))], "member_id string, d timestamp, opened timestamp")
    early = frame([("A", D(2024, 12, 31), D(2025, 1, 1))], "member_id string, d timestamp, opened timestamp")
    snapshot.assert_no_future(ok, "d", OBS)
    snapshot.assert_enrolled(ok, "d", "opened")
    with pytest.raises(AssertionError, match="1 rows after"):
        snapshot.assert_no_future(late, "d", OBS)
    with pytest.raises(AssertionError, match="before enrolment"):
        snapshot.assert_enrolled(early, "d", "opened")
    with pytest.raises(KeyError):
        snapshot.assert_no_future(ok, "nope", OBS)


@pytest.mark.parametrize("text, expected", [
    (None, ("base", 0, None, "stable")), ("[]", ("base", 0, None, "stable")), ("{oops", ("base", 0, None, "unknown")), ("", ("base", 0, None, "unknown")),
    ('[{"tier": "Gold", "date": "2026-01-01"}]', ("base", 0, None, "stable")),
    ('[{"tier": "Silver", "date": "2024-01-01"}]', ("silver", 0, None, "stable")),
    ('[{"tier": "gold", "date": "2025-06-01"}, {"tier": "silver", "date": "2024-01-01"}]', ("silver", 1, 730 / 30.4375, "down")),
    ('[{"tier": "base", "date": "2024-01-01"}, {"tier": "platinum", "date": "2025-12-01"}]', ("platinum", 1, 30 / 30.4375, "up")),
    ('[{"tier": "gold", "date": "not a date"}]', ("base", 0, None, "unknown"))])
def test_tier_as_of(frame, text, expected):
    r = tier.tier_as_of(frame([("A", text)], "member_id string, tier_history string"), OBS).first()
    got = (r.current_tier, r.tier_changes_count, r.months_since_last_tier_change, r.tier_trajectory_direction)
    assert got == (expected[0], expected[1], pytest.approx(expected[2]) if expected[2] is not None else None, expected[3])


def test_slope_matches_polyfit_and_skips_empty_weeks(frame):
    amounts = {D(2025, 12, 2): 10.0, D(2025, 12, 4): 5.0, D(2025, 12, 17): 40.0, D(2025, 12, 30): 25.0}
    txns = _txn(frame, [(str(i), "A", d, a, "purchase", "w", "c", 0, 0) for i, (d, a) in enumerate(amounts.items())]
                + [("x", "B", D(2025, 12, 9), 9.0, "purchase", "w", "c", 0, 0), ("y", "B", D(2025, 12, 30), 9.0, "return", "w", "c", 0, 0)])
    out = {r.member_id: r for r in snapshot.weekly_slopes(txns, [OBS]).collect()}
    assert out["A"].spend_slope_30d == pytest.approx(np.polyfit([0, 1, 2], [15.0, 40.0, 25.0], 1)[0])
    assert out["A"].frequency_slope_30d == pytest.approx(np.polyfit([0, 1, 2], [2, 1, 1], 1)[0])
    assert (out["B"].spend_slope_30d, out["B"].frequency_slope_30d) == (0.0, 0.0)


def test_velocity(frame):
    base = dict(spend_total_30d=0.0, spend_total_90d=0.0, purchase_count_30d=0.0, purchase_count_90d=0.0, app_open_30d=0.0, app_open_90d=0.0,
                email_open_30d=0.0, push_open_30d=0.0, recency_days=None)

    def run(**kw):
        row = {**base, **kw}
        return features.add_velocity(frame([tuple(row.values())], ", ".join(f"{k} double" for k in row))).first()

    assert run().recency_risk == 999.0 and run().spend_velocity == 0.0 and run().spend_decline_flag == 1
    assert run(recency_days=40.0, purchase_count_30d=20.0).recency_risk == 0.0
    assert run(spend_total_30d=1e6, spend_total_90d=1.0).spend_velocity == 10.0
    assert run(spend_total_30d=100.0, spend_total_90d=300.0).spend_velocity == pytest.approx(1.0, abs=1e-6)
    assert run(spend_total_30d=100.0, spend_total_90d=300.0).spend_decline_flag == 0
    assert run(app_open_30d=1.0, email_open_30d=2.0, push_open_30d=3.0).engagement_score == 6.0
    assert features.add_velocity(frame([("A",)], "member_id string")).first().recency_risk == 999.0


def test_deltas_and_segment_history(frame):
    now = frame([("A", 10.0, 3.0), ("B", 5.0, 1.0), ("C", None, 2.0)], "member_id string, spend_total_30d double, purchase_count_30d double")
    before = frame([("A", 4.0, 1.0), ("C", 3.0, 2.0)], "member_id string, spend_total_30d double, purchase_count_30d double")
    out = {r.member_id: r for r in features.add_deltas(now, before, features.delta_columns(now.columns)).collect()}
    assert (out["A"].d_spend_total_30d, out["B"].d_spend_total_30d, out["C"].d_spend_total_30d) == (6.0, 5.0, -3.0)
    with pytest.raises(KeyError):
        features.add_deltas(now, before.drop("spend_total_30d"), ["spend_total_30d"])
    hist = features.add_segment_history(frame([(1, 2), (None, 2), (2, 2)], "prev int, seg_curr int"), "prev").collect()
    assert [(r.seg_prev, r.seg_changed) for r in hist] == [(1.0, 1), (2.0, 0), (2.0, 0)]


def test_panel_gap_is_no_prior_month(frame):
    rows = [("A", D(2025, 1, 1), 5.0), ("A", D(2025, 2, 1), 9.0), ("A", D(2025, 4, 1), 20.0)]
    panel = frame(rows, "member_id string, observation_date timestamp, spend_slope_30d double")
    out = features.add_acceleration(panel).orderBy("observation_date").collect()
    assert [r.spend_acceleration for r in out] == [0.0, 4.0, 0.0]
    month_end = frame([("A", D(2025, 11, 30), 1.0), ("A", D(2025, 12, 31), 4.0)], "member_id string, observation_date timestamp, spend_slope_30d double")
    assert features.add_acceleration(month_end).agg(F.max("spend_acceleration")).first()[0] == 3.0


def test_model_matrix_contract(frame):
    df = frame([("A", None, 2.0)], "member_id string, a double, b double")
    assert list(features.model_matrix(df, ["a", "b"]).first().features) == [0.0, 2.0]
    with pytest.raises(KeyError):
        features.model_matrix(df, ["a", "zzz"])


def test_feature_profiles_have_their_published_width():
    assert len(features.behavioural_features(features.BEHAVIOURAL_FEATURES)) == 45
    assert len(features.behavioural_features(features.BEHAVIOURAL_FEATURES, "shipped")) == 40


def test_plan_needs_no_wide_member_shuffle_for_snapshots(frame):
    """Snapshot assembly has no cross join, and every fact aggregation combines before its exchange."""
    members = _members(frame, [("A", D(2020, 1, 1), None)])
    txns = _txn(frame, [("1", "A", D(2025, 12, 1), 10.0, "purchase", "web", "c1", 5, 0)])
    events = _evt(frame, [("A", D(2025, 12, 24), "app_open", 30.0)])
    plan = snapshot.build_snapshots(members.select("member_id", "account_open_date"), txns, events, members, ["2025-11-30", OBS])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "partial_sum" in text and "partial_min" in text


def test_spend_limits_do_not_depend_on_the_order_of_rows(frame):
    """Amounts of the same total reach a limit in any order; plain sums of doubles differ in the last bits."""
    amounts = (174.55, 472.87, 252.58)
    orders = list(permutations(amounts))
    assert len({a + b + c for a, b, c in orders}) > 1 and max(a + b + c for a, b, c in orders) > 900
    members = _members(frame, [(f"M{i}", D(2020, 1, 1), None) for i in range(len(orders))])
    txns = _txn(frame, [(f"{i}-{j}", f"M{i}", D(2025, 12, 1), a, "purchase", "web", "c1", 5, 0) for i, o in enumerate(orders) for j, a in enumerate(o)])
    events = _evt(frame, [("M0", D(2025, 12, 24), "app_open", 30.0)])
    out = snapshot.build_snapshots(members.select("member_id", "account_open_date"), txns.coalesce(1), events, members, [OBS])
    assert {r.spend_total_90d for r in out.collect()} == {900.0}


def test_rows_per_member_and_date_are_not_dealt_again(frame):
    """Facts meet the spine dealt by member; aggregates, joins and neighbouring months need no exchange by member and date."""
    members = _members(frame, [("A", D(2020, 1, 1), None)])
    txns = _txn(frame, [("1", "A", D(2025, 12, 1), 10.0, "purchase", "web", "c1", 5, 0)])
    events = _evt(frame, [("A", D(2025, 12, 24), "app_open", 30.0)])
    panel = features.engineer_features(snapshot.build_snapshots(members.select("member_id", "account_open_date"), txns, events, members, ["2025-11-30", OBS]))
    text = panel._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", text)
    assert dealt and not [keys for keys in dealt if "observation_date" in keys or "kind" in keys or "step" in keys]


def test_stored_stages_are_not_dealt_round_robin(frame):
    df = frame([(i, float(i)) for i in range(1000)], "k long, v double").coalesce(1)
    kept = cut_lineage(df, fine=True)
    assert len(kept.inputFiles()) == 1 and kept.count() == 1000
