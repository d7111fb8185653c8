"""Feature engineering on snapshots, month-over-month changes and the model matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.functions.exprs import clip, filled, indicator, lookup, ratio
from memberlens.operators.clean import clip_to_bounds
from memberlens.schema import TIER_ORDINALS, WINDOW_DAYS

# The behavioural feature list, source profile.
BEHAVIOURAL_FEATURES = (
    "spend_total_7d",
    "spend_total_30d",
    "spend_total_90d",
    "spend_total_180d",
    "avg_order_value_30d",
    "spend_per_purchase_90d",
    "purchase_count_7d",
    "purchase_count_30d",
    "purchase_count_90d",
    "purchase_count_180d",
    "return_count_30d",
    "return_count_90d",
    "recency_days",
    "redemption_rate",
    "hoarding_ratio",
    "points_earned_lifetime",
    "points_redeemed_lifetime",
    "app_open_30d",
    "app_open_90d",
    "email_open_30d",
    "email_click_30d",
    "email_click_rate_30d",
    "browse_to_purchase_ratio_30d",
    "browsed_but_never_purchased_30d",
    "push_open_30d",
    "reward_browse_30d",
    "reward_redemption_30d",
    "tier_status_check_30d",
    "support_contact_30d",
    "total_session_sec_30d",
    "social_share_30d",
    "referral_sent_30d",
    "survey_completed_30d",
    "point_balance_check_30d",
    "profile_update_30d",
    "spend_slope_30d",
    "frequency_slope_30d",
    "spend_acceleration",
    "category_diversity_90d",
    "channel_diversity_90d",
    "unique_categories_90d",
    "unique_channels_90d",
    "tier_ordinal",
    "tier_changes_count",
    "months_since_last_tier_change",
)

# Features the shipped profile lacks.
NOT_IN_SHIPPED_PROFILE = (
    "social_share_30d",
    "referral_sent_30d",
    "survey_completed_30d",
    "point_balance_check_30d",
    "profile_update_30d",
)

# Columns differenced month over month.
DELTA_COLUMNS = (
    "spend_total_30d",
    "spend_total_90d",
    "purchase_count_30d",
    "purchase_count_90d",
    "recency_days",
    "spend_slope_30d",
    "app_open_30d",
    "email_open_30d",
    "push_open_30d",
    "redemption_rate",
    "category_diversity_90d",
    "avg_order_value_30d",
    "tier_ordinal",
)

VELOCITY_COLUMNS = (
    "spend_velocity",
    "freq_velocity",
    "app_velocity",
    "recency_risk",
    "engagement_score",
    "spend_decline_flag",
)

SEGMENT_HISTORY_COLUMNS = ("seg_prev", "seg_changed")

NEVER_PURCHASED_RECENCY = 999.0

RATIO_BOUNDS = {"hoarding_ratio": (0.0, 10.0), "browse_to_purchase_ratio_30d": (0.0, 10.0)}


def behavioural_features(available: Sequence[str], profile: str = "source") -> list[str]:
    """The allowlist in its fixed order, limited to existing columns."""
    skipped = NOT_IN_SHIPPED_PROFILE if profile == "shipped" else ()
    return [c for c in BEHAVIOURAL_FEATURES if c in available and c not in skipped]


def loyalty_columns() -> dict[str, Column]:
    earned = F.col("points_earned_lifetime")
    return {
        "redemption_rate": clip(ratio(F.col("points_redeemed_lifetime"), earned), 0.0, 1.0),
        "hoarding_ratio": clip(ratio(F.col("current_point_balance_reconstructed"), earned), 0.0, 10.0),
    }


def spend_columns() -> dict[str, Column]:
    return {
        "avg_order_value_30d": ratio(F.col("spend_total_30d"), F.col("purchase_count_30d")),
        "spend_per_purchase_90d": ratio(F.col("spend_total_90d"), F.col("purchase_count_90d")),
    }


def engagement_columns() -> dict[str, Column]:
    bought, browsed = F.col("purchase_count_30d"), F.col("reward_browse_30d")
    return {
        # there is no "sent" event, so the rate is the plain number of opens
        "email_open_rate_30d": F.col("email_open_30d").cast("double"),
        "email_click_rate_30d": clip(ratio(F.col("email_click_30d"), F.col("email_open_30d")), 0.0, 1.0),
        "browse_to_purchase_ratio_30d": clip(ratio(browsed, bought), 0.0, 10.0),
        "browsed_but_never_purchased_30d": indicator((browsed > 0) & (bought == 0)),
    }


def diversity_columns(windows: Sequence[int] = WINDOW_DAYS) -> dict[str, Column]:
    columns = {}
    for days in windows:
        bought = F.col(f"purchase_count_{days}d")
        columns[f"category_diversity_{days}d"] = clip(ratio(F.col(f"unique_categories_{days}d"), bought), 0.0, 1.0)
        columns[f"channel_diversity_{days}d"] = clip(ratio(F.col(f"unique_channels_{days}d"), bought), 0.0, 1.0)
    return columns


def tier_ordinal_column() -> Column:
    return F.coalesce(lookup(F.lower("current_tier"), TIER_ORDINALS, 0), F.lit(0)).cast("long")


def completeness_column() -> Column:
    return indicator((F.col("purchase_count_180d") >= 1) | F.col("recency_days").isNotNull())


# --- previous month ----------------------------------------------------------------

def _by_member():
    return Window.partitionBy("member_id").orderBy("observation_date")


def _month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def prior_value(column: Column, months: int = 1) -> Column:
    """Value of the row one calendar month earlier; null when that month is absent.

    Months are compared by number, so the last days of months follow one another.
    A member has one row per observation date, so the window stays small.
    """
    day = F.col("observation_date")
    is_prior = _month_number(F.lag(day).over(_by_member())) == _month_number(day) - months
    return F.when(is_prior, F.lag(column).over(_by_member()))


def next_value(column: Column) -> Column:
    day = F.col("observation_date")
    is_next = _month_number(F.lead(day).over(_by_member())) == _month_number(day) + 1
    return F.when(is_next, F.lead(column).over(_by_member()))


def add_acceleration(panel: DataFrame) -> DataFrame:
    """Slope minus the prior month's slope; 0 when there is no prior month at all in the panel's history."""
    slope = F.col("spend_slope_30d")
    has_prior = prior_value(F.lit(True)).isNotNull()
    return panel.withColumn(
        "spend_acceleration",
        F.when(has_prior, slope - F.coalesce(prior_value(slope), F.lit(0.0))).otherwise(F.lit(0.0)))


def engineer_features(snapshots: DataFrame, bounds: dict | None = None) -> DataFrame:
    """All feature families on a snapshot panel. Negative tenure (not yet enrolled) is kept."""
    if "account_open_date" not in snapshots.columns:
        raise KeyError("account_open_date is needed for tenure_days")
    panel = snapshots.withColumns({
        **spend_columns(), **loyalty_columns(), **engagement_columns(), **diversity_columns(),
        "tier_ordinal": tier_ordinal_column(), "feature_complete": completeness_column()})
    panel = add_acceleration(panel)
    return clip_to_bounds(panel, bounds) if bounds else panel


# --- velocity and change --------------------------------------------------------------

def velocity_columns() -> dict[str, Column]:
    def pace(base: str) -> Column:
        return filled(f"{base}_30d") / (filled(f"{base}_90d") / 3.0 + F.lit(1e-6))

    spend = pace("spend_total")
    slack = clip(F.lit(1.0) - filled("purchase_count_30d") / 10.0, 0.0, 1.0)
    return {
        "spend_velocity": clip(spend, 0.0, 10.0),
        "freq_velocity": clip(pace("purchase_count"), 0.0, 10.0),
        "app_velocity": clip(pace("app_open"), 0.0, 10.0),
        "recency_risk": filled("recency_days", NEVER_PURCHASED_RECENCY) * slack,
        "engagement_score": filled("app_open_30d") + filled("email_open_30d") + filled("push_open_30d"),
        # taken from the ratio before it is clipped
        "spend_decline_flag": indicator(spend < 0.5),
    }


def with_absent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add absent columns as null, so that expressions can fill them."""
    return df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns})


_VELOCITY_INPUTS = (
    "spend_total_30d", "spend_total_90d", "purchase_count_30d", "purchase_count_90d",
    "app_open_30d", "app_open_90d", "email_open_30d", "push_open_30d", "recency_days")


def add_velocity(df: DataFrame) -> DataFrame:
    absent = [c for c in _VELOCITY_INPUTS if c not in df.columns]
    return with_absent(df, absent).withColumns(velocity_columns()).drop(*absent)


def delta_columns(available: Sequence[str]) -> list[str]:
    return [c for c in DELTA_COLUMNS if c in available]


def add_deltas(current: DataFrame, prior: DataFrame, columns: Sequence[str] = DELTA_COLUMNS) -> DataFrame:
    """Change against another month's table. A member absent there counts as 0 before."""
    absent = [c for c in columns if c not in prior.columns]
    if absent:
        raise KeyError(f"prior month lacks {absent}")
    before = prior.select("member_id", *[F.col(c).cast("double").alias(f"_prev_{c}") for c in columns])
    joined = current.join(before, "member_id", "left")
    return joined.withColumns({
        f"d_{c}": filled(c) - filled(f"_prev_{c}") for c in columns}).drop(*[f"_prev_{c}" for c in columns])


def add_panel_deltas(panel: DataFrame, columns: Sequence[str] = DELTA_COLUMNS) -> DataFrame:
    """The same change for every month of a panel at once."""
    return panel.withColumns({
        f"d_{c}": filled(c) - F.coalesce(prior_value(F.col(c).cast("double")), F.lit(0.0)) for c in columns})


def add_segment_history(df: DataFrame, previous: str, current: str = "seg_curr") -> DataFrame:
    """seg_prev (the current segment where unknown) and whether it changed."""
    prev = F.coalesce(F.col(previous), F.col(current))
    return df.withColumns({"seg_prev": prev.cast("double"), "seg_changed": indicator(prev != F.col(current))})


def model_matrix(df: DataFrame, columns: Sequence[str], output: str = "features", keep: Sequence[str] | None = None) -> DataFrame:
    """Assemble a feature vector. Absent columns raise; null values become 0."""
    from pyspark.ml.feature import VectorAssembler

    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"feature column(s) absent: {absent}")
    kept = list(keep) if keep is not None else df.columns
    inputs = {c: f"_x{i}" for i, c in enumerate(columns)}
    filled_in = df.withColumns({alias: filled(c) for c, alias in inputs.items()})
    vectors = VectorAssembler(inputCols=list(inputs.values()), outputCol=output, handleInvalid="error").transform(filled_in)
    return vectors.select(*kept, output)
