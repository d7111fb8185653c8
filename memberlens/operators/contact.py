"""Who may be contacted, on which channel, and how responsive they have been."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.functions.exprs import clip, count_where, elapsed_days, half_even, lookup, ts
from memberlens.functions.scalars import beside

CHANNELS = ("email", "push", "sms")

# Preferred channels per state, best first.
CHANNEL_PREFERENCE = {
    "Lapse Risk": ("email", "sms", "push"),
    "Win-Back Target": ("email", "sms", "push"),
    "Silent Accumulator": ("push", "email", "sms"),
    "Momentum Builder": ("push", "email", "sms"),
    "Brand Advocate": ("push", "email", "sms"),
    "New & Uncertain": ("push", "email", "sms"),
    "Redemption Hunter": ("email", "push", "sms"),
    "Value Maximizer": ("email", "push", "sms"),
    "Plateau Cruiser": ("email", "push", "sms"),
    "Program Skeptic": ("email", "push", "sms"),
}

# Message guidance per state.
STATE_MESSAGES = {
    "Lapse Risk": "personalised win-back, bonus points, within 7 days",
    "Win-Back Target": "we-miss-you reactivation bonus, immediate",
    "Silent Accumulator": "unspent points reminder, weekly cadence",
    "Momentum Builder": "tier upgrade progress, immediate",
    "Brand Advocate": "early access + referral bonus, immediate",
    "New & Uncertain": "onboarding journey, first-purchase bonus",
    "Redemption Hunter": "targeted flash promotion around promo periods",
    "Value Maximizer": "cross-category points multiplier, mid-month",
    "Plateau Cruiser": "curated recommendation, monthly",
    "Program Skeptic": "re-permission with value proof, monthly",
}

# Suppression reasons in words.
REASON_TEXTS = {
    "account_closed": "Account closed — suppress from all marketing",
    "fraud_flagged": "Fraud-flagged — suppress pending investigation",
    "no_channel_consent": "No channel consent on file — not contactable",
    "frequency_cap": "Frequency cap reached — contacted often enough in the last 30 days",
}

FREQUENCY_CAP_30D = 6
PRIOR_TOUCHES = 20.0
BASE_RECOVERY_RATE = 0.10

REQUIRED_MEMBER_COLUMNS = ("member_id", "account_status", "fraud_flag", "opt_in_email", "opt_in_push", "opt_in_sms")
REQUIRED_EVENT_COLUMNS = ("member_id", "campaign_id", "campaign_response")


def _require(df: DataFrame, columns) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"missing column(s): {absent}")


def _is_set(column: str) -> Column:
    """A null flag counts as not set; for consent that means no consent."""
    return F.coalesce(F.col(column), F.lit(False))


def contact_profile(members: DataFrame) -> DataFrame:
    _require(members, REQUIRED_MEMBER_COLUMNS)
    status = F.lower(F.trim("account_status"))
    flags = members.select(
        "member_id", "account_status",
        F.coalesce(status == "closed", F.lit(False)).alias("is_closed"),
        F.coalesce(status == "dormant", F.lit(False)).alias("is_dormant"),
        _is_set("fraud_flag").alias("is_fraud"),
        *[_is_set(f"opt_in_{c}").alias(f"allow_{c}") for c in CHANNELS])
    allowed = sum((F.col(f"allow_{c}").cast("long") for c in CHANNELS), F.lit(0).cast("long"))
    # most serious reason first
    reason = (F.when(F.col("is_closed"), "account_closed").when(F.col("is_fraud"), "fraud_flagged")
              .when(F.col("n_channels_allowed") == 0, "no_channel_consent").otherwise(""))
    return (flags.withColumn("n_channels_allowed", allowed).withColumn("suppression_reason", reason)
            .withColumn("is_targetable", F.col("suppression_reason") == "")
            .withColumn("needs_reactivation_track", F.col("is_dormant") & F.col("is_targetable")))


def best_channel(state: Column) -> Column:
    """First permitted channel in the state's order of preference; null if none is permitted."""
    def in_order(channels) -> Column:
        return F.coalesce(*[F.when(F.col(f"allow_{c}"), F.lit(c)) for c in channels])

    chain = None
    for order in sorted(set(CHANNEL_PREFERENCE.values())):
        names = [s for s, o in CHANNEL_PREFERENCE.items() if o == order]
        condition = state.isin(names)
        chain = F.when(condition, in_order(order)) if chain is None else chain.when(condition, in_order(order))
    return chain.otherwise(in_order(CHANNELS))


def recommend(profile: DataFrame, state: str = "state_name") -> DataFrame:
    """Adds recommended_channel ('' = do not contact) and recommended_action."""
    _require(profile, [state])
    s = F.col(state)
    channel = F.when(F.col("is_targetable"), best_channel(s))
    reason = F.coalesce(lookup(F.col("suppression_reason"), REASON_TEXTS), F.lit("Suppressed"))
    message = F.coalesce(lookup(s, STATE_MESSAGES), F.lit("standard lifecycle message"))
    track = F.when(F.col("needs_reactivation_track"), F.lit("REACTIVATION TRACK | ")).otherwise(F.lit(""))
    action = (F.when(~F.col("is_targetable"), F.concat(F.lit("DO NOT CONTACT: "), reason))
              .when(F.col("recommended_channel") == "", F.lit("DO NOT CONTACT: no permitted channel for this state"))
              .otherwise(F.concat(track, F.lit("Channel: "), F.col("recommended_channel"), F.lit(" | "), message)))
    return (profile.withColumn("recommended_channel", F.coalesce(channel, F.lit("")))
            .withColumn("recommended_action", action))


def eligibility_summary(profile: DataFrame) -> DataFrame:
    reason = F.col("suppression_reason")
    return profile.agg(
        F.count(F.lit(1)).alias("members"),
        count_where(F.col("is_targetable")).alias("targetable"),
        count_where(~F.col("is_targetable")).alias("suppressed"),
        *[count_where(reason == r).alias(r) for r in ("account_closed", "fraud_flagged", "no_channel_consent")],
        count_where(F.col("needs_reactivation_track")).alias("dormant_reactivation"),
        *[count_where(F.col(f"allow_{c}")).alias(f"allow_{c}") for c in CHANNELS])


# --- history -----------------------------------------------------------------------

def contact_history(events: DataFrame, date: str, date_column: str = "event_date") -> DataFrame:
    """Campaign contacts and responses per member as of the date. Members never contacted are absent."""
    _require(events, [*REQUIRED_EVENT_COLUMNS, date_column])
    observed = ts(date)
    touches = events.where(F.col("campaign_id").isNotNull() & (F.col(date_column) <= observed))
    age = elapsed_days(observed, F.col(date_column))
    answer = F.lower(F.trim("campaign_response"))
    recent = age <= 180
    counts = touches.groupBy("member_id").agg(
        count_where(age <= 30).alias("contacts_30d"), count_where(age <= 90).alias("contacts_90d"),
        count_where(recent).alias("contacts_180d"),
        count_where(recent & answer.isin("opened", "clicked")).alias("responses_180d"),
        count_where(recent & (answer == "clicked")).alias("clicks_180d"),
        F.min(age).alias("days_since_last_contact"))
    return counts.withColumn("response_rate_raw", F.try_divide(F.col("responses_180d").cast("double"), F.col("contacts_180d").cast("double")))


def population_response(history: DataFrame) -> DataFrame:
    """One row: the response rate of everybody, 0 without contacts."""
    return history.agg(F.coalesce(F.try_divide(F.sum("responses_180d").cast("double"), F.sum("contacts_180d").cast("double")),
                                  F.lit(0.0)).alias("population_rate"))


def response_propensity(history: DataFrame, prior: float = PRIOR_TOUCHES) -> DataFrame:
    """Response rate shrunk towards the population and the multiple of the population rate."""
    pop = F.col("population_rate")
    joined = beside(history, population_response(history))
    smoothed = (F.col("responses_180d") + F.lit(prior) * pop) / (F.col("contacts_180d") + F.lit(prior))
    return joined.withColumn("response_rate_smoothed", smoothed).withColumn(
        "response_multiplier", F.coalesce(F.try_divide(F.col("response_rate_smoothed"), pop), F.lit(1.0)))


def frequency_cap(profile: DataFrame, cap: int = FREQUENCY_CAP_30D) -> DataFrame:
    """Suppress members contacted too often. Other reasons are kept, being more telling."""
    _require(profile, ["contacts_30d"])
    capped = F.col("is_targetable") & (F.coalesce(F.col("contacts_30d"), F.lit(0)) >= cap)
    return (profile.withColumn("_capped", capped)
            .withColumn("suppression_reason", F.when(F.col("_capped"), "frequency_cap").otherwise(F.col("suppression_reason")))
            .withColumn("is_targetable", F.col("is_targetable") & ~F.col("_capped")).drop("_capped"))


def effective_recovery(multiplier: Column, base: float = BASE_RECOVERY_RATE, low: float = 0.25, high: float = 2.5) -> Column:
    return F.lit(base) * clip(multiplier, low, high)


def contact_eligibility(members: DataFrame, events: DataFrame, states: DataFrame, date: str,
                        base_rate: float = BASE_RECOVERY_RATE) -> DataFrame:
    """Per scored member: eligibility, consent, history, recovery rate and recommendation.

    Nobody contacted yet: 0 contacts, the rate of everybody, multiplier 1. Ids that the member
    table lacks keep their row, with every permission off and the reason `not_in_member_file`.
    """
    history = contact_history(events, date)
    rated = response_propensity(history).drop("population_rate")
    pop = population_response(history)
    profile = contact_profile(members).join(
        rated.select("member_id", "contacts_30d", "contacts_90d", "contacts_180d", "responses_180d",
                     "days_since_last_contact", "response_rate_smoothed", "response_multiplier"), "member_id", "left")
    capped = frequency_cap(profile)
    out = beside(states.select("member_id", "state_name").join(capped, "member_id", "left"), pop)
    flags = ["is_targetable", "needs_reactivation_track", *[f"allow_{c}" for c in CHANNELS]]
    counts = ["contacts_30d", "contacts_90d", "contacts_180d", "responses_180d"]
    out = out.withColumns({
        **{f: _is_set(f) for f in flags},
        **{c: F.coalesce(F.col(c), F.lit(0)) for c in counts},
        "response_rate_smoothed": F.coalesce(F.col("response_rate_smoothed"), F.col("population_rate")),
        "response_multiplier": F.coalesce(F.col("response_multiplier"), F.lit(1.0)),
        "suppression_reason": F.coalesce(F.col("suppression_reason"), F.lit("not_in_member_file"))})
    out = recommend(out).withColumn("observation_date", ts(date)).withColumn(
        "effective_recovery_rate", half_even(effective_recovery(F.col("response_multiplier"), base_rate), 4))
    return out.select(
        "member_id", "observation_date", "state_name", "is_targetable", "suppression_reason",
        "needs_reactivation_track", "allow_email", "allow_push", "allow_sms", "contacts_30d", "contacts_90d",
        "days_since_last_contact", "response_rate_smoothed", "response_multiplier", "effective_recovery_rate",
        "recommended_channel", "recommended_action")
