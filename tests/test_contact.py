import datetime as dt

import pytest
from pyspark.sql import functions as F

from memberlens.operators import contact

OBS = "2025-12-31"
AT = dt.datetime(2025, 12, 31)
MEMBER = "member_id string, account_status string, fraud_flag boolean, opt_in_email boolean, opt_in_push boolean, opt_in_sms boolean"


def _one(frame, status="active", fraud=False, email=True, push=True, sms=True):
    return contact.contact_profile(frame([("A", status, fraud, email, push, sms)], MEMBER))


@pytest.mark.parametrize("kw, reason", [
    (dict(), ""), (dict(status="closed"), "account_closed"), (dict(status=" CLOSED "), "account_closed"), (dict(fraud=True), "fraud_flagged"), (dict(fraud=None), ""),
    (dict(email=False, push=False, sms=False), "no_channel_consent"), (dict(email=None, push=None, sms=None), "no_channel_consent"),
    (dict(status="closed", fraud=True, email=False, push=False, sms=False), "account_closed"), (dict(fraud=True, email=False, push=False, sms=False), "fraud_flagged"),
    (dict(status="dormant"), ""), (dict(status=None), "")])
def test_suppression_severity(frame, kw, reason):
    r = _one(frame, **kw).first()
    assert r.suppression_reason == reason and r.is_targetable == (reason == "")
    assert r.needs_reactivation_track == (kw.get("status") == "dormant")


def test_missing_column_raises(frame):
    with pytest.raises(KeyError):
        contact.contact_profile(frame([("A",)], "member_id string"))


def test_channel_preference_and_fallback(frame):
    rows = [("Lapse Risk", True, True, True), ("Lapse Risk", False, True, True), ("Lapse Risk", False, True, False), ("Silent Accumulator", True, True, True),
            ("Plateau Cruiser", False, True, True), ("Plateau Cruiser", False, False, False), ("Something else", False, False, True)]
    df = frame(rows, "s string, allow_email boolean, allow_push boolean, allow_sms boolean")
    assert [r.c for r in df.select(contact.best_channel(F.col("s")).alias("c")).collect()] == ["email", "sms", "push", "push", "push", None, "sms"]


def test_recommendation_texts(frame):
    active = contact.recommend(_one(frame).withColumn("state_name", F.lit("Lapse Risk"))).first()
    assert active.recommended_channel == "email" and active.recommended_action.startswith("Channel: email | ")
    dormant = contact.recommend(_one(frame, status="dormant").withColumn("state_name", F.lit("Lapse Risk"))).first()
    assert dormant.recommended_action.startswith("REACTIVATION TRACK | ")
    closed = contact.recommend(_one(frame, status="closed").withColumn("state_name", F.lit("Lapse Risk"))).first()
    assert closed.recommended_channel == "" and closed.recommended_action.startswith("DO NOT CONTACT: Account closed")


def _events(frame, rows):
    """rows: (member, days before the observation date, campaign, response)"""
    return frame([(m, AT - dt.timedelta(days=d), c, r) for m, d, c, r in rows], "member_id string, event_date timestamp, campaign_id string, campaign_response string")


def test_history_windows(frame):
    rows = [("A", 0, "k", "Opened"), ("A", 30, "k", "clicked "), ("A", 30.9, "k", "sent"), ("A", 31, "k", "none"), ("A", 90, "k", "opened"), ("A", 180, "k", None),
            ("A", 181, "k", "clicked"), ("A", -0.1, "k", "clicked"), ("A", 5, None, "clicked"), ("B", 200, "k", "opened")]
    out = {r.member_id: r for r in contact.contact_history(_events(frame, rows), OBS).collect()}
    a, b = out["A"], out["B"]
    assert (a.contacts_30d, a.contacts_90d, a.contacts_180d, a.responses_180d, a.clicks_180d, a.days_since_last_contact) == (3, 5, 6, 3, 1, 0)
    assert (b.contacts_180d, b.response_rate_raw, b.days_since_last_contact) == (0, None, 200)
    assert contact.contact_history(_events(frame, [("A", 5, None, "opened")]), OBS).count() == 0


def test_shrinkage(frame):
    h = frame([("A", 10, 5), ("B", 0, 0), ("C", 30, 5)], "member_id string, contacts_180d long, responses_180d long")
    out = {r.member_id: r for r in contact.response_propensity(h).collect()}
    pop = 10 / 40
    assert out["A"].response_rate_smoothed == pytest.approx((5 + 20 * pop) / 30)
    assert out["B"].response_multiplier == pytest.approx(1.0)
    none = frame([("A", 3, 0)], "member_id string, contacts_180d long, responses_180d long")
    assert contact.response_propensity(none).first().response_multiplier == 1.0


def test_frequency_cap_keeps_other_reasons(frame):
    p = frame([("A", 6, True, ""), ("B", 5, True, ""), ("C", 9, False, "account_closed"), ("D", None, True, "")], "member_id string, contacts_30d int, is_targetable boolean, suppression_reason string")
    out = {r.member_id: (r.is_targetable, r.suppression_reason) for r in contact.frequency_cap(p).collect()}
    assert out == {"A": (False, "frequency_cap"), "B": (True, ""), "C": (False, "account_closed"), "D": (True, "")}
    with pytest.raises(KeyError):
        contact.frequency_cap(p.drop("contacts_30d"))


def test_recovery_is_bounded(frame):
    df = frame([(0.0,), (1.0,), (99.0,)], "m double")
    assert [r.e for r in df.select(contact.effective_recovery(F.col("m")).alias("e")).collect()] == pytest.approx([0.025, 0.1, 0.25])


def test_eligibility_defaults(frame):
    members = frame([("A", "active", False, True, None, None)], MEMBER)
    states = frame([("A", "Lapse Risk"), ("Z", "Lapse Risk")], "member_id string, state_name string")
    out = {r.member_id: r for r in contact.contact_eligibility(members, _events(frame, [("Q", 5, "k", "opened")]), states, OBS).collect()}
    assert (out["A"].contacts_30d, out["A"].response_multiplier, out["A"].recommended_channel) == (0, 1.0, "email")
    assert (out["Z"].suppression_reason, out["Z"].is_targetable, out["Z"].recommended_action) == ("not_in_member_file", False, "DO NOT CONTACT: Suppressed")
