import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from memberlens.operators import states

NEUTRAL = dict(tenure_days=400.0, recency_days=10.0, purchase_count_30d=0.0, spend_slope_30d=0.0, redemption_rate=0.0, app_open_30d=0.0, email_open_30d=0.0,
               push_open_30d=0.0, social_share_30d=0.0, referral_sent_30d=0.0, survey_completed_30d=0.0, tier_ordinal=0.0, category_diversity_90d=0.0)

CASES = [
    (dict(), "Program Skeptic"),
    (dict(tenure_days=89.0), "New & Uncertain"), (dict(tenure_days=90.0), "Program Skeptic"), (dict(tenure_days=-20.0), "New & Uncertain"),
    (dict(tenure_days=None), "Program Skeptic"), (dict(tenure_days=10.0, recency_days=70.0, email_open_30d=1.0), "New & Uncertain"),
    (dict(recency_days=61.0, app_open_30d=1.0), "Win-Back Target"), (dict(recency_days=60.0, app_open_30d=1.0), "Lapse Risk"),
    (dict(recency_days=None, push_open_30d=1.0), "Win-Back Target"), (dict(recency_days=None), "Lapse Risk"),
    (dict(recency_days=31.0), "Lapse Risk"), (dict(recency_days=30.0), "Program Skeptic"), (dict(recency_days=40.0, spend_slope_30d=0.1), "Program Skeptic"),
    (dict(recency_days=40.0, purchase_count_30d=1.0, spend_slope_30d=-3.0), "Silent Accumulator"),
    (dict(spend_slope_30d=5.1, purchase_count_30d=2.0, category_diversity_90d=0.31), "Momentum Builder"),
    (dict(spend_slope_30d=5.0, purchase_count_30d=2.0, category_diversity_90d=0.31, app_open_30d=1.0), "Plateau Cruiser"),
    (dict(spend_slope_30d=9.0, purchase_count_30d=1.0, category_diversity_90d=0.31, app_open_30d=1.0), "Program Skeptic"),
    (dict(spend_slope_30d=9.0, purchase_count_30d=2.0, category_diversity_90d=0.3, app_open_30d=1.0), "Program Skeptic"),
    (dict(spend_slope_30d=9.0, purchase_count_30d=2.0, category_diversity_90d=0.31, recency_days=30.0, app_open_30d=1.0), "Program Skeptic"),
    (dict(email_open_30d=2.0, tier_ordinal=2.0, category_diversity_90d=0.41), "Brand Advocate"), (dict(app_open_30d=3.0, tier_ordinal=2.0, category_diversity_90d=0.41), "Brand Advocate"),
    (dict(social_share_30d=1.0, tier_ordinal=3.0, category_diversity_90d=0.41), "Brand Advocate"), (dict(survey_completed_30d=1.0, tier_ordinal=2.0, category_diversity_90d=0.41), "Brand Advocate"),
    (dict(referral_sent_30d=1.0, tier_ordinal=2.0, category_diversity_90d=0.4), "Program Skeptic"), (dict(email_open_30d=2.0, tier_ordinal=1.0, category_diversity_90d=0.45), "Program Skeptic"),
    (dict(redemption_rate=0.31, purchase_count_30d=1.0), "Redemption Hunter"), (dict(redemption_rate=0.30, purchase_count_30d=1.0), "Silent Accumulator"),
    (dict(redemption_rate=0.31, purchase_count_30d=2.0, category_diversity_90d=0.51), "Value Maximizer"),
    (dict(redemption_rate=0.10, category_diversity_90d=0.6), "Program Skeptic"), (dict(redemption_rate=0.11, category_diversity_90d=0.51), "Value Maximizer"),
    (dict(purchase_count_30d=1.0), "Silent Accumulator"), (dict(purchase_count_30d=1.0, push_open_30d=1.0), "Plateau Cruiser"),
    (dict(purchase_count_30d=1.0, push_open_30d=1.0, spend_slope_30d=-2.0), "Plateau Cruiser"), (dict(purchase_count_30d=1.0, push_open_30d=1.0, spend_slope_30d=-2.1), "Program Skeptic"),
    (dict(purchase_count_30d=1.0, push_open_30d=1.0, spend_slope_30d=5.1), "Program Skeptic"),
]


def test_cascade_bounds_and_priority(frame):
    rows = [(i, *{**NEUTRAL, **change}.values()) for i, (change, _) in enumerate(CASES)]
    df = frame(rows, "i int, " + ", ".join(f"{c} double" for c in NEUTRAL))
    got = {r.i: r.state_name for r in states.classify_states(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_absent_columns_read_as_their_fill(frame):
    r = states.classify_states(frame([("A", 400.0)], "member_id string, tenure_days double")).first()
    assert r.state_name == "Lapse Risk" and r.state_id == 3


def test_ids_follow_priority_and_reject_unknown(frame):
    df = frame([(s,) for s in states.STATES], "s string")
    assert {r.s: r.i for r in df.select("s", states.state_id(F.col("s")).alias("i")).collect()} == states.STATE_IDS
    with pytest.raises(PySparkException):
        frame([("Nope",)], "s string").select(states.state_id(F.col("s"))).collect()


def test_every_state_has_texts(frame):
    cols = {**NEUTRAL, "purchase_count_7d": 0.0, "purchase_count_90d": 3.0, "purchase_count_180d": 3.0}
    df = frame([(s, *cols.values()) for s in states.STATES], "s string, " + ", ".join(f"{c} double" for c in cols))
    for r in df.select(states.rule_sentence(F.col("s")).alias("a"), states.supporting_evidence(F.col("s")).alias("b"), states.state_confidence(F.col("s")).alias("c")).collect():
        assert r.a and ":" in r.b and 0.55 <= r.c <= 0.95


def test_confidence_margins(frame):
    df = frame([("Lapse Risk", 45.0, 0.0), ("Lapse Risk", None, 0.0), ("Momentum Builder", 1.0, 6.0), ("Plateau Cruiser", 1.0, 0.0)], "s string, recency_days double, spend_slope_30d double")
    assert [r.c for r in df.select(states.state_confidence(F.col("s")).alias("c")).collect()] == [0.95, 0.95, 0.82, 0.68]
