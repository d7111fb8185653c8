"""Table contracts and the fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values ---------------------------------------------------------------

EVENT_TYPES = (
    "app_open",
    "email_open",
    "email_click",
    "push_open",
    "push_dismiss",
    "point_balance_check",
    "reward_browse",
    "reward_redemption",
    "tier_status_check",
    "support_contact",
    "social_share",
    "referral_sent",
    "survey_completed",
    "profile_update",
)

WINDOW_DAYS = (7, 30, 90, 180)

TIER_ORDINALS = {"base": 0, "silver": 1, "gold": 2, "platinum": 3}

GHOST_PREFIX = "MBR_GHOST_"

SESSION_CAP_SECONDS = 14400.0

EVENT_KEY = ("member_id", "event_date", "event_type")

# Tables -----------------------------------------------------------------------


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


MEMBERS = _table(
    ("member_id", T.StringType()),
    ("account_open_date", T.TimestampType()),
    ("account_close_date", T.TimestampType()),
    ("account_status", T.StringType()),
    ("fraud_flag", T.BooleanType()),
    ("opt_in_email", T.BooleanType()),
    ("opt_in_push", T.BooleanType()),
    ("opt_in_sms", T.BooleanType()),
    ("credit_line", T.DoubleType()),
    ("tier_history", T.StringType()),
)

TRANSACTIONS = _table(
    ("transaction_id", T.StringType()),
    ("member_id", T.StringType()),
    ("transaction_date", T.StringType()),
    ("transaction_amount", T.DoubleType()),
    ("transaction_type", T.StringType()),
    ("channel", T.StringType()),
    ("merchant_category", T.StringType()),
    ("merchant_subcategory", T.StringType()),
    ("merchant_brand", T.StringType()),
    ("points_earned", T.LongType()),
    ("points_clawed_back", T.LongType()),
)

ENGAGEMENT_EVENTS = _table(
    ("member_id", T.StringType()),
    ("event_date", T.StringType()),
    ("event_type", T.StringType()),
    ("event_channel", T.StringType()),
    ("session_duration_sec", T.DoubleType()),
    ("campaign_id", T.StringType()),
    ("campaign_response", T.StringType()),
)

TIER_HISTORY = T.ArrayType(_table(("tier", T.StringType()), ("date", T.StringType())))
