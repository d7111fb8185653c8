"""Lifecycle states: one rule cascade used for labels, scoring and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.functions.exprs import clip, filled, half_even, lookup, shortest_text
from memberlens.operators.features import with_absent

# State names in priority order; their position is the state id.
STATES = (
    "New & Uncertain",
    "Win-Back Target",
    "Lapse Risk",
    "Momentum Builder",
    "Brand Advocate",
    "Redemption Hunter",
    "Value Maximizer",
    "Silent Accumulator",
    "Plateau Cruiser",
    "Program Skeptic",
)
STATE_IDS = {name: i for i, name in enumerate(STATES, start=1)}

# Inputs of the cascade and what a null stands for.
STATE_INPUTS = {
    "tenure_days": 999.0,
    "recency_days": 999.0,
    "purchase_count_30d": 0.0,
    "spend_slope_30d": 0.0,
    "redemption_rate": 0.0,
    "app_open_30d": 0.0,
    "email_open_30d": 0.0,
    "push_open_30d": 0.0,
    "social_share_30d": 0.0,
    "referral_sent_30d": 0.0,
    "survey_completed_30d": 0.0,
    "tier_ordinal": 0.0,
    "category_diversity_90d": 0.0,
}


def state_conditions() -> dict[str, Column]:
    """Condition of every state but the last one, in priority order."""
    v = {name: filled(name, fill) for name, fill in STATE_INPUTS.items()}
    tenure, recency = v["tenure_days"], v["recency_days"]
    bought, slope, redeemed = v["purchase_count_30d"], v["spend_slope_30d"], v["redemption_rate"]
    app, email, push = v["app_open_30d"], v["email_open_30d"], v["push_open_30d"]
    tier, breadth = v["tier_ordinal"], v["category_diversity_90d"]
    touched = (app > 0) | (email > 0) | (push > 0)
    engaged = ((email >= 2) | (app >= 3) | (v["social_share_30d"] >= 1) | (v["referral_sent_30d"] >= 1)
               | (v["survey_completed_30d"] >= 1))
    rules = (
        tenure < 90,
        (recency > 60) & touched,
        (recency > 30) & (bought == 0) & (slope <= 0),
        (slope > 5) & (bought >= 2) & (recency < 30) & (breadth > 0.3),
        engaged & (tier >= 2) & (breadth > 0.4),
        (redeemed > 0.30) & (bought <= 1),
        (breadth > 0.50) & (redeemed > 0.10),
        (bought >= 1) & (app == 0) & (email == 0) & (push == 0),
        slope.between(-2, 5) & (bought >= 1),
    )
    # The limits above, in the order of STATES.
    return dict(zip(STATES, rules))


def state_column() -> Column:
    chain = None
    for name, rule in state_conditions().items():
        chain = F.when(rule, name) if chain is None else chain.when(rule, name)
    return chain.otherwise(STATES[-1])


def state_id(name: Column) -> Column:
    """Id of a state name; an unknown name fails the job."""
    known = lookup(name, STATE_IDS)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown state: "), F.coalesce(name, F.lit("null"))))
                      .cast("int")).cast("long")


def classify_states(features: DataFrame) -> DataFrame:
    absent = [c for c in STATE_INPUTS if c not in features.columns]
    return (with_absent(features, absent).withColumn("state_name", state_column())
            .withColumn("state_id", state_id(F.col("state_name"))).drop(*absent))


# --- texts ---------------------------------------------------------------------------

def _whole(name: str) -> Column:
    return filled(name).cast("long").cast("string")


def _rounded(name: str, digits: int) -> Column:
    return shortest_text(filled(name), digits)


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def rule_sentence(state: Column) -> Column:
    """Why the state was given, in words."""
    # The sentence of every state.
    sentences = {
        "New & Uncertain": _say(
            "Member enrolled ", _whole("tenure_days"),
            " days ago — too early to establish a reliable behavioural pattern. Onboarding journey applies."),
        "Win-Back Target": _say(
            "Member has been inactive for ", _rounded("recency_days", 1),
            " days (60+ day lapse) but showed a digital re-engagement signal this month — email open, app visit, "
            "or push click detected."),
        "Lapse Risk": _say(
            "Member has not purchased in ", _rounded("recency_days", 1),
            " days and spend trend is declining (slope: ", _rounded("spend_slope_30d", 2),
            "). Without intervention within 30 days, full lapse is likely."),
        "Momentum Builder": _say(
            "Member is on an upward trajectory — spend rising at +", _rounded("spend_slope_30d", 1),
            " per week, with ", _whole("purchase_count_30d"),
            " purchases in the last 30 days across diverse categories. Most likely to reach the next tier within "
            "60 days."),
        "Brand Advocate": _say(
            "Member is deeply engaged across multiple programme touchpoints — holds tier level ",
            _whole("tier_ordinal"), " (Gold or Platinum) and shops across ", _rounded("category_diversity_90d", 2),
            " normalised category breadth. High email and app activity confirm programme affinity."),
        "Redemption Hunter": _say(
            "Member redeems ", _rounded("redemption_rate", 1), "% of earned points and made only ",
            _whole("purchase_count_30d"),
            " purchase(s) this month — behaviour is driven by redemption events rather than regular spending."),
        "Value Maximizer": _say(
            "Member shops strategically across categories (diversity: ", _rounded("category_diversity_90d", 2),
            ") and redeems ", _rounded("redemption_rate", 1),
            "% of earned points — optimising both earn rate and reward value."),
        "Silent Accumulator": _say(
            "Member made ", _whole("purchase_count_30d"),
            " purchase(s) this month but opened zero emails, zero app sessions, and zero push notifications. "
            "They earn points consistently but ignore all programme communications."),
        "Plateau Cruiser": _say(
            "Member is in a stable routine — ", _whole("purchase_count_30d"),
            " purchase(s) this month with a flat spend trend (slope: ", _rounded("spend_slope_30d", 1),
            "). No growth or decline detected; behaviour has been consistent for multiple months."),
        "Program Skeptic": _say(
            "No strong behavioural signal detected this month; the member is enrolled but not actively engaging "
            "with the programme."),
    }
    return _by_state(state, sentences)


def _by_state(state: Column, table: dict[str, Column]) -> Column:
    chain = None
    for name, value in table.items():
        chain = F.when(state == name, value) if chain is None else chain.when(state == name, value)
    return chain


def supporting_evidence(state: Column) -> Column:
    """metric:value list behind the state."""
    bought, third = filled("purchase_count_30d"), filled("purchase_count_90d") / 3.0
    decline = F.rint((bought - third) / (third + 1.0) * 100.0).cast("long").cast("string")
    earlier = F.greatest(filled("purchase_count_90d") - filled("purchase_count_7d").cast("long"), F.lit(0.0)).cast("long").cast("string")
    # The metrics shown for each state.
    metrics = {
        "Lapse Risk": [
            ("txn_decline", F.concat(decline, F.lit("%"))), ("recency_days", _whole("recency_days")),
            ("purchases_30d", _whole("purchase_count_30d"))],
        "Momentum Builder": [
            ("spend_slope", _rounded("spend_slope_30d", 1)), ("purchases_30d", _whole("purchase_count_30d")),
            ("tier", _whole("tier_ordinal"))],
        "Silent Accumulator": [
            ("app_opens_30d", _whole("app_open_30d")), ("email_opens_30d", _whole("email_open_30d")),
            ("purchases_30d", _whole("purchase_count_30d"))],
        "Brand Advocate": [
            ("app_opens_30d", _whole("app_open_30d")), ("email_opens_30d", _whole("email_open_30d")),
            ("tier", _whole("tier_ordinal")), ("category_diversity", _rounded("category_diversity_90d", 2))],
        "Program Skeptic": [
            ("app_opens_30d", _whole("app_open_30d")), ("email_opens_30d", _whole("email_open_30d")),
            ("purchases_30d", _whole("purchase_count_30d"))],
        "Win-Back Target": [
            ("purchases_7d", _whole("purchase_count_7d")), ("prior_83d_activity", earlier),
            ("recency_days", _whole("recency_days"))],
        "Value Maximizer": [
            ("redemption_rate", _rounded("redemption_rate", 2)),
            ("category_diversity", _rounded("category_diversity_90d", 2)),
            ("purchases_30d", _whole("purchase_count_30d"))],
        "Redemption Hunter": [
            ("redemption_rate", _rounded("redemption_rate", 2)), ("purchases_30d", _whole("purchase_count_30d"))],
        "Plateau Cruiser": [
            ("spend_slope", _rounded("spend_slope_30d", 1)), ("purchases_30d", _whole("purchase_count_30d")),
            ("recency_days", _whole("recency_days"))],
        "New & Uncertain": [
            ("purchase_count_180d", _whole("purchase_count_180d")), ("account_age_days", F.lit("unknown"))],
    }
    texts = {name: F.concat_ws(",", *[F.concat(F.lit(f"{key}:"), value) for key, value in pairs])
             for name, pairs in metrics.items()}
    return F.coalesce(_by_state(state, texts), F.lit("no_dominant_signal:true"))


def state_confidence(state: Column) -> Column:
    """Margin beyond the deciding threshold, within [0.55, 0.95]."""
    lapse = F.lit(0.60) + clip((filled("recency_days", 999.0) - 30.0) / 30.0, 0.0, 0.35)
    momentum = F.lit(0.62) + clip((filled("spend_slope_30d") - 5.0) / 5.0, 0.0, 0.33)
    raw = (F.when(state == "Lapse Risk", clip(lapse, 0.55, 0.95))
           .when(state == "Momentum Builder", clip(momentum, 0.55, 0.95))
           .when(state == "New & Uncertain", F.lit(0.55))
           .when(state == "Win-Back Target", F.lit(0.62))
           .otherwise(F.lit(0.68)))
    return half_even(raw, 4)


# --- monthly analytics -------------------------------------------------------------------

def attach_segments(states: DataFrame, segments: DataFrame) -> DataFrame:
    """State rows with their month's segment; unmatched rows get -1 / Unknown."""
    key = ["member_id", "observation_date"]
    joined = states.join(segments.select(*key, "segment_id", "segment_name"), key, "left")
    return joined.withColumns({
        "segment_id": F.coalesce(F.col("segment_id"), F.lit(-1)).cast("long"),
        "segment_name": F.coalesce(F.col("segment_name"), F.lit("Unknown")),
        "observation_month": F.date_format("observation_date", "yyyy_MM")})


def cross_table(states: DataFrame, row: str = "segment_name", column: str = "state_name") -> DataFrame:
    """Counts by (row, column) with TOTAL margins, rows without a segment left out."""
    known = states.where(F.col(row) != "Unknown")
    cube = known.cube(row, column).agg(F.count(F.lit(1)).alias("n_members"), F.grouping(row).alias("_r"),
                                       F.grouping(column).alias("_c"))
    return cube.select(F.when(F.col("_r") == 1, "TOTAL").otherwise(F.col(row)).alias(row),
                       F.when(F.col("_c") == 1, "TOTAL").otherwise(F.col(column)).alias(column), "n_members")


def wide_cross_table(states: DataFrame, row: str = "segment_name", column: str = "state_name") -> DataFrame:
    """The cross table with one column per state."""
    return (cross_table(states, row, column).groupBy(row).pivot(column, [*STATES, "TOTAL"])
            .agg(F.sum("n_members")).na.fill(0))


def transition_matrix(states: DataFrame) -> DataFrame:
    """Row-normalised month-to-month transitions in long form, rounded to 4 digits.

    Only pairs of rows 28 to 35 days apart count as consecutive months.
    """
    w = Window.partitionBy("member_id").orderBy("observation_date")
    nxt = states.select("member_id", "observation_date", "state_name",
                        F.lead("state_name").over(w).alias("state_next"),
                        F.lead("observation_date").over(w).alias("_next_date"))
    gap = F.datediff("_next_date", "observation_date")
    counts = (nxt.where(F.col("state_next").isNotNull() & gap.between(28, 35))
              .groupBy("state_name", "state_next").agg(F.count(F.lit(1)).alias("n_moves")))
    total = F.sum("n_moves").over(Window.partitionBy("state_name"))
    return counts.withColumn("probability", half_even(F.col("n_moves") / total, 4))


def retention_rates(matrix: DataFrame) -> DataFrame:
    stays = F.max(F.when(F.col("state_name") == F.col("state_next"), F.col("probability")))
    return matrix.groupBy("state_name").agg(F.coalesce(stays, F.lit(0.0)).alias("retention"))


def top_moves(matrix: DataFrame, top: int = 5) -> DataFrame:
    """Most likely moves to another state, ties by name (a top-k report)."""
    return (matrix.where(F.col("state_name") != F.col("state_next"))
            .orderBy(F.desc("probability"), "state_name", "state_next").limit(top))


def state_examples(states: DataFrame) -> DataFrame:
    """The first member of every state by id, found by aggregation."""
    rest = [c for c in states.columns if c not in ("state_name", "member_id")]
    first = states.groupBy("state_name").agg(F.min(F.struct("member_id", *rest)).alias("_f"))
    return first.select("state_name", "_f.*")


def state_distribution(states: DataFrame, by: tuple[str, ...] = ("observation_date",)) -> DataFrame:
    counts = states.groupBy(*by, "state_name").agg(F.count(F.lit(1)).alias("n_members"))
    total = F.sum("n_members").over(Window.partitionBy(*by)) if by else F.sum("n_members").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.col("n_members") / total)
