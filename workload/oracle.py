"""Common table expressions of the comparison SQL.

Written independently of the Spark code: facts are joined to the dates directly,
windows are filters, and every quantity is spelled out.
"""

from __future__ import annotations

import re

from memberlens.schema import EVENT_TYPES
from workload.adapter import MONTHS, OBSERVED, RAW_CTES, SEGMENT_NAMES, SEGMENT_RULE

WINDOWS = (7, 30, 90, 180)


def parsed(column: str) -> str:
    formats = ("%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y")
    return "coalesce(" + ", ".join(f"try_strptime({column}, '{f}')" for f in formats) + ")"


def div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


def clipped(x: str, low, high) -> str:
    return f"greatest({low}, least({high}, {x}))"


def days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS BIGINT)"


def half_even(x: str, digits: int) -> str:
    scale = float(10**digits)
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


def date_list(dates) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"(TIMESTAMP '{d} 00:00:00')" for d in dates) + ") v(observation_date)"


def _txn_windows() -> str:
    parts = []
    for w in WINDOWS:
        inside = f"t.transaction_date >= d.observation_date - INTERVAL {w} DAY"
        bought = f"t.transaction_type = 'purchase' AND {inside}"
        parts += [
            f"sum(t.transaction_amount) FILTER (WHERE {bought}) AS spend_total_{w}d",
            f"count(*) FILTER (WHERE {bought}) AS purchase_count_{w}d",
            f"count(DISTINCT t.merchant_category) FILTER (WHERE {bought}) AS unique_categories_{w}d",
            f"count(DISTINCT t.channel) FILTER (WHERE {inside}) AS unique_channels_{w}d",
            f"count(*) FILTER (WHERE t.transaction_type = 'return' AND {inside}) AS return_count_{w}d",
            f"sum(t.points_earned) FILTER (WHERE {inside}) AS points_earned_{w}d"]
    return (f"SELECT t.member_id, d.observation_date, {', '.join(parts)}, sum(t.points_earned) AS points_earned_lifetime, "
            "sum(t.points_clawed_back) AS points_clawed_back_lifetime, max(t.transaction_date) AS last_transaction_date "
            "FROM enrolled_txn t JOIN dates d ON t.transaction_date <= d.observation_date GROUP BY 1, 2")


def _evt_windows() -> str:
    parts = []
    for w in WINDOWS:
        inside = f"e.event_date >= d.observation_date - INTERVAL {w} DAY"
        parts += [f"count(*) FILTER (WHERE e.event_type = '{t}' AND {inside}) AS {t}_{w}d" for t in EVENT_TYPES]
        parts.append(f"sum(e.session_duration_sec) FILTER (WHERE {inside}) AS total_session_sec_{w}d")
    return (f"SELECT e.member_id, d.observation_date, {', '.join(parts)} FROM enrolled_evt e JOIN dates d "
            "ON e.event_date <= d.observation_date GROUP BY 1, 2")


TXN_COUNTS = [f"{c}_{w}d" for w in WINDOWS for c in ("purchase_count", "unique_categories", "unique_channels", "return_count", "points_earned")]
SPEND = [f"spend_total_{w}d" for w in WINDOWS]
EVT_COUNTS = [f"{t}_{w}d" for w in WINDOWS for t in EVENT_TYPES]
SESSION = [f"total_session_sec_{w}d" for w in WINDOWS]

_ORD = "CASE {x} WHEN 'silver' THEN 1 WHEN 'gold' THEN 2 WHEN 'platinum' THEN 3 ELSE 0 END"

STATE_CASE = """CASE
 WHEN tenure_days < 90 THEN 'New & Uncertain'
 WHEN coalesce(recency_days, 999) > 60 AND (email_open_30d > 0 OR app_open_30d > 0 OR push_open_30d > 0) THEN 'Win-Back Target'
 WHEN coalesce(recency_days, 999) > 30 AND purchase_count_30d = 0 AND spend_slope_30d <= 0 THEN 'Lapse Risk'
 WHEN spend_slope_30d > 5 AND purchase_count_30d >= 2 AND coalesce(recency_days, 999) < 30 AND category_diversity_90d > 0.3 THEN 'Momentum Builder'
 WHEN (email_open_30d >= 2 OR app_open_30d >= 3 OR social_share_30d >= 1 OR referral_sent_30d >= 1 OR survey_completed_30d >= 1)
      AND tier_ordinal >= 2 AND category_diversity_90d > 0.4 THEN 'Brand Advocate'
 WHEN redemption_rate > 0.3 AND purchase_count_30d <= 1 THEN 'Redemption Hunter'
 WHEN category_diversity_90d > 0.5 AND redemption_rate > 0.1 THEN 'Value Maximizer'
 WHEN purchase_count_30d >= 1 AND app_open_30d = 0 AND email_open_30d = 0 AND push_open_30d = 0 THEN 'Silent Accumulator'
 WHEN spend_slope_30d BETWEEN -2 AND 5 AND purchase_count_30d >= 1 THEN 'Plateau Cruiser'
 ELSE 'Program Skeptic' END"""

STATES = ("New & Uncertain", "Win-Back Target", "Lapse Risk", "Momentum Builder", "Brand Advocate", "Redemption Hunter", "Value Maximizer",
          "Silent Accumulator", "Plateau Cruiser", "Program Skeptic")
STATE_ID = "CASE state_name " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STATES, 1)) + " END"


def _features() -> str:
    diversity = []
    for w in WINDOWS:
        for kind, col in (("category", "categories"), ("channel", "channels")):
            diversity.append(f"{clipped(div(f'unique_{col}_{w}d', f'purchase_count_{w}d'), 0, 1)} AS {kind}_diversity_{w}d")
    return f"""SELECT s.*,
 {div('spend_total_30d', 'purchase_count_30d')} AS avg_order_value_30d,
 {div('spend_total_90d', 'purchase_count_90d')} AS spend_per_purchase_90d,
 {clipped(div('points_redeemed_lifetime', 'points_earned_lifetime'), 0, 1)} AS redemption_rate,
 {clipped(div('current_point_balance_reconstructed', 'points_earned_lifetime'), 0, 10)} AS hoarding_ratio,
 CAST(email_open_30d AS DOUBLE) AS email_open_rate_30d,
 {clipped(div('email_click_30d', 'email_open_30d'), 0, 1)} AS email_click_rate_30d,
 {clipped(div('reward_browse_30d', 'purchase_count_30d'), 0, 10)} AS browse_to_purchase_ratio_30d,
 CASE WHEN reward_browse_30d > 0 AND purchase_count_30d = 0 THEN 1 ELSE 0 END AS browsed_but_never_purchased_30d,
 {', '.join(diversity)},
 CAST({_ORD.format(x='current_tier')} AS BIGINT) AS tier_ordinal,
 CASE WHEN purchase_count_180d >= 1 OR recency_days IS NOT NULL THEN 1 ELSE 0 END AS feature_complete,
 CASE WHEN p.member_id IS NULL THEN 0 ELSE s.spend_slope_30d - p.spend_slope END AS spend_acceleration
 FROM snapshot s LEFT JOIN (SELECT member_id, observation_date AS prior_date, spend_slope_30d AS spend_slope FROM snapshot) p
 ON p.member_id = s.member_id AND p.prior_date = s.observation_date - INTERVAL 1 MONTH"""


def ctes(dates=MONTHS) -> dict[str, str]:
    return {
        **RAW_CTES,
        "dates": date_list(dates),
        "spine": "SELECT member_id, account_open_date FROM raw_members WHERE NOT starts_with(member_id, 'MBR_GHOST_')",
        "txn": (f"SELECT * REPLACE ({parsed('transaction_date')} AS transaction_date, lower(trim(transaction_type)) AS transaction_type, "
                "lower(trim(channel)) AS channel, lower(trim(merchant_category)) AS merchant_category) FROM raw_transactions "
                "WHERE member_id IN (SELECT member_id FROM spine)"),
        "typed_events": (f"SELECT * REPLACE ({parsed('event_date')} AS event_date, lower(trim(event_type)) AS event_type, "
                         "lower(trim(event_channel)) AS event_channel) FROM raw_events"),
        "evt": "SELECT * FROM clean_evt WHERE member_id IN (SELECT member_id FROM spine)",
        "clean_evt": ("SELECT * EXCLUDE (rn) REPLACE (CASE WHEN session_duration_sec IS NOT NULL THEN least(session_duration_sec, 14400) END AS session_duration_sec) "
                "FROM (SELECT *, row_number() OVER (PARTITION BY member_id, event_date, event_type ORDER BY event_no) AS rn FROM typed_events) WHERE rn = 1"),
        "enrolled_txn": "SELECT t.*, s.account_open_date FROM txn t JOIN spine s USING (member_id) WHERE t.transaction_date >= s.account_open_date",
        "enrolled_evt": "SELECT e.*, s.account_open_date FROM evt e JOIN spine s USING (member_id) WHERE e.event_date >= s.account_open_date",
        "txn_windows": _txn_windows(),
        "evt_windows": _evt_windows(),
        "weeks": ("SELECT t.member_id, d.observation_date, date_trunc('week', t.transaction_date) AS week, sum(t.transaction_amount) AS spend, count(*) AS n "
                  "FROM txn t JOIN spine USING (member_id) JOIN dates d ON t.transaction_date BETWEEN d.observation_date - INTERVAL 30 DAY AND d.observation_date "
                  "WHERE t.transaction_type = 'purchase' GROUP BY 1, 2, 3"),
        "slopes": ("SELECT member_id, observation_date, CASE WHEN count(*) < 2 THEN 0 ELSE " + half_even("regr_slope(spend, x)", 9) + " END AS spend_slope_30d, "
                   "CASE WHEN count(*) < 2 THEN 0 ELSE " + half_even("regr_slope(n, x)", 9) + " END AS frequency_slope_30d "
                   "FROM (SELECT *, row_number() OVER (PARTITION BY member_id, observation_date ORDER BY week) - 1 AS x FROM weeks) GROUP BY 1, 2"),
        "tier_lists": ("SELECT member_id, CASE WHEN tier_history IS NULL THEN [] WHEN json_valid(tier_history) THEN "
                       "from_json(tier_history, '[{\"tier\":\"VARCHAR\",\"date\":\"VARCHAR\"}]') END AS entries FROM raw_members"),
        "tiers_known": ("SELECT l.member_id, d.observation_date, l.entries IS NULL AS unreadable, "
                        "list_filter(coalesce(l.entries, []), lambda e: CAST(e.\"date\" AS TIMESTAMP) <= d.observation_date) AS known "
                        "FROM tier_lists l CROSS JOIN dates d"),
        "tiers": (f"SELECT member_id, observation_date, CASE WHEN len(known) = 0 THEN 'base' ELSE lower(known[-1].tier) END AS current_tier, "
                  f"CAST(greatest(len(known) - 1, 0) AS BIGINT) AS tier_changes_count, "
                  f"CASE WHEN len(known) > 1 THEN {days('observation_date', 'CAST(known[-1].date AS TIMESTAMP)')} / 30.4375 END AS months_since_last_tier_change, "
                  f"CASE WHEN unreadable THEN 'unknown' WHEN len(known) < 2 THEN 'stable' "
                  f"WHEN {_ORD.format(x='lower(known[-1].tier)')} > {_ORD.format(x='lower(known[-2].tier)')} THEN 'up' "
                  f"WHEN {_ORD.format(x='lower(known[-1].tier)')} < {_ORD.format(x='lower(known[-2].tier)')} THEN 'down' ELSE 'stable' END AS tier_trajectory_direction "
                  "FROM tiers_known"),
        "snapshot": ("SELECT s.member_id, s.account_open_date, d.observation_date, "
                     + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in TXN_COUNTS + EVT_COUNTS) + ", "
                     + ", ".join(f"coalesce({c}, 0) AS {c}" for c in SPEND + SESSION) + ", "
                     "CAST(coalesce(points_earned_lifetime, 0) AS BIGINT) AS points_earned_lifetime, "
                     "CAST(coalesce(points_clawed_back_lifetime, 0) AS BIGINT) AS points_clawed_back_lifetime, "
                     "CAST(coalesce(points_clawed_back_lifetime, 0) AS BIGINT) AS points_redeemed_lifetime, "
                     "CAST(greatest(0, coalesce(points_earned_lifetime, 0) - coalesce(points_clawed_back_lifetime, 0)) AS BIGINT) AS current_point_balance_reconstructed, "
                     f"w.last_transaction_date, {days('d.observation_date', 'w.last_transaction_date')} AS recency_days, "
                     "t.current_tier, t.tier_changes_count, t.months_since_last_tier_change, t.tier_trajectory_direction, "
                     f"{days('d.observation_date', 's.account_open_date')} AS tenure_days, "
                     "coalesce(o.spend_slope_30d, 0) AS spend_slope_30d, coalesce(o.frequency_slope_30d, 0) AS frequency_slope_30d "
                     "FROM spine s CROSS JOIN dates d LEFT JOIN txn_windows w ON w.member_id = s.member_id AND w.observation_date = d.observation_date "
                     "LEFT JOIN evt_windows e ON e.member_id = s.member_id AND e.observation_date = d.observation_date "
                     "LEFT JOIN slopes o ON o.member_id = s.member_id AND o.observation_date = d.observation_date "
                     "LEFT JOIN tiers t ON t.member_id = s.member_id AND t.observation_date = d.observation_date"),
        "features": _features(),
        "states": (f"SELECT *, {STATE_ID} AS state_id FROM (SELECT *, {STATE_CASE} AS state_name, {SEGMENT_RULE} AS segment_id FROM features)"),
        "named": ("SELECT *, CASE segment_id " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(SEGMENT_NAMES)) + " END AS segment_name FROM states"),
    }


def query(final: str, dates=MONTHS, **extra: str) -> str:
    """WITH clause of everything `final` needs, in dependency order, followed by `final`."""
    known = {**ctes(dates), **extra}
    order: list[str] = []

    def visit(text: str, stack: tuple[str, ...] = ()) -> None:
        for name in known:
            if name not in stack and re.search(rf"\b{name}\b", text):
                if name not in order:
                    visit(known[name], (*stack, name))
                    if name not in order:
                        order.append(name)

    visit(final)
    clause = ",\n".join(f"{n} AS ({known[n]})" for n in order)
    return (f"WITH {clause}\n" if order else "") + final


def at_observed(final: str, **extra: str) -> str:
    return query(final, (OBSERVED,), **extra)
