"""Snapshots, features and their validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from memberlens.operators import features, snapshot, tier, validate
from memberlens.operators.features import BEHAVIOURAL_FEATURES
from workload import stages
from workload.adapter import MONTHS, OBSERVED
from workload.oracle import EVT_COUNTS, SESSION, SPEND, TXN_COUNTS, WINDOWS, half_even
from workload.oracle import at_observed as sql_at
from workload.oracle import query as sql
from workload.registry import big, query, r6, rounded, when

_KEY = "member_id, " + when("observation_date", "observation_date")


def _cols(columns, doubles=()):
    return ", ".join(r6(c, c) if c in doubles else c for c in columns)


# --- as-of rows and guards ----------------------------------------------------------------

@query("as_of_filter", sql(f"SELECT member_id, count(*) AS n_rows, {when('max(transaction_date)', 'latest')} FROM txn "
                           f"WHERE transaction_date <= TIMESTAMP '{OBSERVED} 00:00:00' GROUP BY 1"))
def _(spark, sf):
    _, _, transactions, _ = stages.facts(spark, sf)
    return rounded(snapshot.as_of(transactions, "transaction_date", OBSERVED).groupBy("member_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("transaction_date").alias("latest")))


@query("pre_enrolment_removal", sql("SELECT member_id, count(*) AS n_rows FROM enrolled_txn GROUP BY 1"))
def _(spark, sf):
    _, spine, transactions, _ = stages.facts(spark, sf)
    return snapshot.after_enrolment(transactions, spine, "transaction_date").groupBy("member_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("no_future_guard", sql(
    f"SELECT count(*) FILTER (WHERE late) AS n_violations, {when('max(transaction_date) FILTER (WHERE late)', 'latest')}, min(member_id) FILTER (WHERE late) AS example_member "
    f"FROM (SELECT *, transaction_date > TIMESTAMP '{MONTHS[3]} 00:00:00' AS late FROM txn)"))
def _(spark, sf):
    """What the guard sees in unfiltered rows; on filtered rows it must stay silent."""
    _, _, transactions, _ = stages.facts(spark, sf)
    snapshot.assert_no_future(snapshot.as_of(transactions, "transaction_date", MONTHS[3]), "transaction_date", MONTHS[3], "filtered transactions")
    return rounded(snapshot.future_rows(transactions, "transaction_date", MONTHS[3]))


@query("pre_enrolment_guard", sql(
    "SELECT count(*) FILTER (WHERE early) AS n_violations, min(member_id) FILTER (WHERE early) AS example_member FROM "
    "(SELECT t.member_id, t.transaction_date < s.account_open_date AS early FROM txn t JOIN spine s USING (member_id))"))
def _(spark, sf):
    _, spine, transactions, _ = stages.facts(spark, sf)
    snapshot.assert_enrolled(snapshot.after_enrolment(transactions, spine, "transaction_date"), "transaction_date")
    return snapshot.early_rows(snapshot.with_enrolment(transactions, spine), "transaction_date", "account_open_date")


# --- windows -----------------------------------------------------------------------------------

def _windowed(name: str, columns: list[str], doubles=()):
    """One query per family of window columns, all months, built from the conformed facts."""
    @query(name, sql(f"SELECT {_KEY}, {_cols(columns, doubles)} FROM snapshot"))
    def _(spark, sf):
        return rounded(stages.fresh_snapshots(spark, sf).select("member_id", "observation_date", *columns))


_windowed("rolling_spend_windows", SPEND + [f"purchase_count_{w}d" for w in WINDOWS], SPEND)
_windowed("unique_category_windows", [f"unique_categories_{w}d" for w in WINDOWS])
_windowed("unique_channel_windows", [f"unique_channels_{w}d" for w in WINDOWS])
_windowed("return_count_windows", [f"return_count_{w}d" for w in WINDOWS])
_windowed("points_earned_windows", [f"points_earned_{w}d" for w in WINDOWS])
_windowed("event_type_pivot", EVT_COUNTS)
_windowed("session_second_windows", SESSION, SESSION)
_windowed("lifetime_points", ["points_earned_lifetime", "points_clawed_back_lifetime"])
_windowed("redeemed_points_and_balance", ["points_redeemed_lifetime", "current_point_balance_reconstructed"])


@query("recency", sql(f"SELECT {_KEY}, {when('last_transaction_date', 'last_transaction_date')}, recency_days FROM snapshot"))
def _(spark, sf):
    return rounded(stages.fresh_snapshots(spark, sf).select("member_id", "observation_date", "last_transaction_date", "recency_days"))


_TIER = ["current_tier", "tier_changes_count", "months_since_last_tier_change", "tier_trajectory_direction"]


@query("tier_as_of", sql_at(f"SELECT member_id, {_cols(_TIER, ['months_since_last_tier_change'])} FROM tiers"))
def _(spark, sf):
    members, _, _, _ = stages.facts(spark, sf)
    return rounded(tier.tier_as_of(members, OBSERVED))


@query("tenure", sql(f"SELECT {_KEY}, tenure_days FROM snapshot"))
def _(spark, sf):
    return rounded(stages.fresh_snapshots(spark, sf).select("member_id", "observation_date", "tenure_days"))


_ALL = TXN_COUNTS + EVT_COUNTS + ["points_earned_lifetime", "current_point_balance_reconstructed", "recency_days", "tenure_days", "current_tier",
                                  "tier_changes_count", "tier_trajectory_direction"]


@query("single_date_snapshot", sql_at(f"SELECT {_KEY}, {_cols(SPEND + SESSION, SPEND + SESSION)}, {_cols(_ALL)} FROM snapshot"))
def _(spark, sf):
    return rounded(stages.fresh_snapshots(spark, sf, (OBSERVED,)).select("member_id", "observation_date", *SPEND, *SESSION, *_ALL))


@query("multi_date_panel", sql(f"SELECT {_KEY}, {_cols(SPEND + SESSION, SPEND + SESSION)}, {_cols(_ALL)} FROM snapshot"))
def _(spark, sf):
    return rounded(stages.fresh_snapshots(spark, sf).select("member_id", "observation_date", *SPEND, *SESSION, *_ALL))


@query("snapshot_audit", sql(
    f"SELECT {when('observation_date', 'observation_date')}, count(*) AS n_members, count(*) FILTER (WHERE purchase_count_7d > 0) AS active_7d, "
    f"count(*) FILTER (WHERE purchase_count_30d > 0) AS active_30d, {r6('count(*) FILTER (WHERE purchase_count_7d > 0) / CAST(count(*) AS DOUBLE) * 100', 'pct_active_7d')}, "
    f"{r6('count(*) FILTER (WHERE purchase_count_30d > 0) / CAST(count(*) AS DOUBLE) * 100', 'pct_active_30d')} FROM snapshot GROUP BY observation_date"))
def _(spark, sf):
    return rounded(snapshot.snapshot_audit(stages.snapshots(spark, sf)))


# --- features ------------------------------------------------------------------------------------

def _featured(name: str, columns: list[str], doubles=None):
    """One query per feature family, computed on the stored snapshots of all months."""
    doubles = columns if doubles is None else doubles

    @query(name, sql(f"SELECT {_KEY}, {', '.join(r6(c, c) if c in doubles else big(c, c) for c in columns)} FROM features"))
    def _(spark, sf):
        return rounded(features.engineer_features(stages.snapshots(spark, sf)).select("member_id", "observation_date", *columns))


_featured("negative_tenure_kept", ["tenure_days"], [])
_featured("order_value_features", ["avg_order_value_30d", "spend_per_purchase_90d"])
_featured("loyalty_features", ["redemption_rate", "hoarding_ratio"])
_featured("email_features", ["email_open_rate_30d", "email_click_rate_30d"])
_featured("browse_features", ["browse_to_purchase_ratio_30d", "browsed_but_never_purchased_30d"], ["browse_to_purchase_ratio_30d"])
_featured("spend_acceleration", ["spend_acceleration"])
_featured("diversity_features", [f"{k}_diversity_{w}d" for w in WINDOWS for k in ("category", "channel")])
_featured("tier_ordinal", ["tier_ordinal"], [])
_featured("feature_complete_flag", ["feature_complete"], [])


@query("weekly_slopes", sql(f"SELECT {_KEY}, {r6('spend_slope_30d', 'spend_slope_30d')}, {r6('frequency_slope_30d', 'frequency_slope_30d')} FROM slopes"))
def _(spark, sf):
    _, spine, transactions, _ = stages.facts(spark, sf)
    mine = transactions.join(spine.select("member_id"), "member_id", "left_semi")
    return rounded(snapshot.weekly_slopes(mine, MONTHS))


def _matrix_sql(columns, source, keep):
    """Width of the rows and the sum of their values, each times its place: differs if a column is missing, doubled or moved."""
    total = " + ".join(f"{i + 1} * coalesce(CAST({c} AS DOUBLE), 0)" for i, c in enumerate(columns))
    return f"SELECT {keep}, CAST({len(columns)} AS BIGINT) AS n_features, {total} AS placed FROM {source}"


_PROFILES = {p: features.behavioural_features(BEHAVIOURAL_FEATURES, p) for p in ("source", "shipped")}


@query("behavioural_profiles", sql(" UNION ALL ".join(
    f"SELECT '{p}' AS profile, count(*) AS n_rows, max(n_features) AS n_features, {r6('sum(placed)', 'placed', 3)} FROM ({_matrix_sql(c, 'features', 'member_id')})" for p, c in _PROFILES.items())))
def _(spark, sf):
    """The assembled matrix of the stored panel under both allowlists."""
    from pyspark.ml.functions import vector_to_array

    panel, parts = stages.panel(spark, sf), []
    for profile in _PROFILES:
        rows = features.model_matrix(panel, features.behavioural_features(panel.columns, profile)).select(vector_to_array("features").alias("x"))
        parts.append(rows.agg(F.lit(profile).alias("profile"), F.count(F.lit(1)).alias("n_rows"), F.max(F.size("x")).cast("long").alias("n_features"), F.sum(_placed("x")).alias("placed")))
    return rounded(parts[0].union(parts[1]), 3)


def _placed(x):
    return F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, v: acc + v)


_VELOCITY = f"""SELECT {_KEY},
 {r6('greatest(0, least(10, v.s))', 'spend_velocity')}, {r6('greatest(0, least(10, v.f))', 'freq_velocity')}, {r6('greatest(0, least(10, v.a))', 'app_velocity')},
 {r6('coalesce(recency_days, 999) * greatest(0, least(1, 1 - purchase_count_30d / 10e0))', 'recency_risk')},
 {r6('app_open_30d + email_open_30d + push_open_30d', 'engagement_score')}, {big('v.s < 0.5', 'spend_decline_flag')}
 FROM (SELECT *, {{'s': spend_total_30d / (spend_total_90d / 3 + 1e-6), 'f': purchase_count_30d / (purchase_count_90d / 3e0 + 1e-6),
 'a': app_open_30d / (app_open_90d / 3e0 + 1e-6)}} AS v FROM features)"""


@query("velocity_features", sql(_VELOCITY))
def _(spark, sf):
    return rounded(features.add_velocity(stages.panel(spark, sf)).select("member_id", "observation_date", *features.VELOCITY_COLUMNS))


_DELTAS = ", ".join(r6(f"coalesce(c.{c}, 0) - coalesce(p.{c}, 0)", f"d_{c}", 8) for c in features.DELTA_COLUMNS)


@query("month_over_month_deltas", sql(
    f"SELECT c.member_id, {when('c.observation_date', 'observation_date')}, {_DELTAS} FROM features c LEFT JOIN features p "
    "ON p.member_id = c.member_id AND p.observation_date = c.observation_date - INTERVAL 1 MONTH"))
def _(spark, sf):
    out = features.add_panel_deltas(stages.panel(spark, sf))
    return rounded(out.select("member_id", "observation_date", *[f"d_{c}" for c in features.DELTA_COLUMNS]), 8)


@query("two_month_deltas", sql(
    f"SELECT c.member_id, {_DELTAS} FROM features c LEFT JOIN (SELECT * FROM features WHERE observation_date = TIMESTAMP '{MONTHS[-2]} 00:00:00') p USING (member_id) "
    f"WHERE c.observation_date = TIMESTAMP '{MONTHS[-1]} 00:00:00'"))
def _(spark, sf):
    panel = stages.panel(spark, sf)
    out = features.add_deltas(stages.month(panel, MONTHS[-1]), stages.month(panel, MONTHS[-2]))
    return rounded(out.select("member_id", *[f"d_{c}" for c in features.DELTA_COLUMNS]), 8)


@query("segment_history", sql(
    f"SELECT c.member_id, {when('c.observation_date', 'observation_date')}, CAST(coalesce(p.segment_id, c.segment_id) AS DOUBLE) AS seg_prev, "
    f"{big('coalesce(p.segment_id, c.segment_id) <> c.segment_id', 'seg_changed')} FROM states c LEFT JOIN states p "
    "ON p.member_id = c.member_id AND p.observation_date = c.observation_date - INTERVAL 1 MONTH"))
def _(spark, sf):
    panel = stages.panel(spark, sf).withColumn("_prev", features.prior_value(F.col("segment_id")))
    return rounded(features.add_segment_history(panel, "_prev", "segment_id").select("member_id", "observation_date", "seg_prev", "seg_changed"))


@query("model_matrix", sql_at(f"SELECT member_id, n_features, {r6('placed', 'placed')} FROM ({_matrix_sql(_PROFILES['source'], 'features', 'member_id')})"))
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    panel = stages.observed_panel(spark, sf)
    matrix = features.model_matrix(panel, features.behavioural_features(panel.columns), keep=["member_id"])
    return rounded(matrix.select("member_id", vector_to_array("features").alias("x")).select("member_id", F.size("x").cast("long").alias("n_features"), _placed("x").alias("placed")))


# --- validation --------------------------------------------------------------------------------

# Every column of the panel except states and segments, in its order.
_SNAPSHOT = [*TXN_COUNTS, *EVT_COUNTS, *SPEND, *SESSION, "points_earned_lifetime", "points_clawed_back_lifetime", "points_redeemed_lifetime", "current_point_balance_reconstructed",
             "last_transaction_date", "recency_days", "current_tier", "tier_changes_count", "months_since_last_tier_change", "tier_trajectory_direction", "tenure_days",
             "spend_slope_30d", "frequency_slope_30d"]
_DERIVED = ["avg_order_value_30d", "spend_per_purchase_90d", "redemption_rate", "hoarding_ratio", "email_open_rate_30d", "email_click_rate_30d", "browse_to_purchase_ratio_30d",
            "browsed_but_never_purchased_30d", *[f"{k}_diversity_{w}d" for w in WINDOWS for k in ("category", "channel")], "tier_ordinal", "feature_complete", "spend_acceleration"]
_FEATURES = [*_SNAPSHOT, *_DERIVED]
_CHECKED = [c for c in _FEATURES if c not in validate.NULLABLE]


def _all_features(spark, sf):
    panel = stages.panel(spark, sf).drop("state_id", "state_name", "segment_id", "segment_name")
    assert set(panel.columns) == {"member_id", "account_open_date", "observation_date", *_FEATURES}
    return panel.select("member_id", "account_open_date", "observation_date", *_FEATURES)


@query("missing_features", sql(
    f"SELECT {when('observation_date', 'observation_date')}, feature, {r6('(n_rows - n) / CAST(n_rows AS DOUBLE)', 'null_rate')} FROM "
    f"(SELECT observation_date, count(*) AS n_rows, {', '.join(f'count({c}) AS {c}' for c in _CHECKED)} FROM broken GROUP BY 1) UNPIVOT (n FOR feature IN ({', '.join(_CHECKED)})) "
    "WHERE (n_rows - n) / CAST(n_rows AS DOUBLE) > 0.05",
    broken="SELECT * REPLACE (CASE WHEN spend_total_30d = 0 THEN NULL ELSE spend_total_30d END AS spend_total_30d, CASE WHEN tenure_days % 10 = 0 THEN NULL ELSE spend_acceleration END AS spend_acceleration) FROM features"))
def _(spark, sf):
    """Zero spend and every tenth tenure read as missing here, so that there is something to find."""
    panel = _all_features(spark, sf).withColumns({"spend_total_30d": F.when(F.col("spend_total_30d") != 0, F.col("spend_total_30d")),
                                                  "spend_acceleration": F.when(F.col("tenure_days") % 10 != 0, F.col("spend_acceleration"))})
    return rounded(validate.missing_features(panel))


_TIGHT = {"recency_days": (0.0, 60.0), "redemption_rate": (0.0, 0.5), "tier_ordinal": (0.0, 3.0), "category_diversity_90d": (0.1, 1.0)}


@query("range_violations", sql(" UNION ALL ".join(
    f"SELECT {when('observation_date', 'observation_date')}, '{c}' AS feature, count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS n_violations, "
    f"{r6(f'min({c})', 'min_value')}, {r6(f'max({c})', 'max_value')} FROM features GROUP BY observation_date HAVING count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) > 0"
    for c, (lo, hi) in _TIGHT.items())))
def _(spark, sf):
    """Bounds tighter than the real domains, which hold on this data."""
    return rounded(validate.range_violations(stages.panel(spark, sf), _TIGHT))


_RULES = {
    **{f"zero_count_with_spend_{w}": f"purchase_count_{w} = 0 AND spend_total_{w} > 0" for w in ("7d", "30d", "90d", "180d")},
    "null_recency_with_purchases": "recency_days IS NULL AND purchase_count_30d > 0",
    "redemption_rate_out_of_bounds": "redemption_rate < 0 OR redemption_rate > 1",
    "infinite_spend_slope_30d": "isinf(spend_slope_30d)", "infinite_frequency_slope_30d": "isinf(frequency_slope_30d)",
    "infinite_spend_acceleration": "isinf(spend_acceleration)"}


@query("business_sanity", sql(" UNION ALL ".join(
    f"SELECT {when('observation_date', 'observation_date')}, '{n}' AS rule, count(*) FILTER (WHERE {c}) AS n_rows, count(*) FILTER (WHERE {c}) > 0 AS failed FROM features GROUP BY observation_date"
    for n, c in _RULES.items())
    + f" UNION ALL SELECT {when('observation_date', 'observation_date')}, 'completeness_of_never_purchased', count(*) FILTER (WHERE purchase_count_180d = 0), "
      "coalesce(avg(feature_complete) FILTER (WHERE purchase_count_180d = 0) > 0.3, false) FROM features GROUP BY observation_date"))
def _(spark, sf):
    return rounded(validate.business_rules(stages.panel(spark, sf)))


_CORRELATED = [c for c in _FEATURES if c not in validate.NOT_CORRELATED]


def _long(columns, source="features"):
    wide = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return (f"SELECT member_id, observation_date, feature, value FROM (SELECT member_id, observation_date, {wide} FROM {source}) "
            f"UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(columns)}))")


_COLLINEAR = {
    "correlated": f"SELECT *, list_position({_CORRELATED}, feature) AS place FROM correlated_values WHERE value IS NOT NULL", "correlated_values": _long(_CORRELATED),
    "pairs": "SELECT observation_date, a.feature AS feature_a, b.feature AS feature_b, abs(corr(a.value, b.value)) AS r FROM correlated a JOIN correlated b USING (member_id, observation_date) "
             "WHERE a.place < b.place GROUP BY 1, 2, 3 HAVING stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 AND abs(corr(a.value, b.value)) > 0.9"}


@query("collinear_pairs", sql(f"SELECT {when('observation_date', 'observation_date')}, feature_a, feature_b, {r6('r', 'r')} FROM pairs", **_COLLINEAR))
def _(spark, sf):
    return rounded(validate.collinear_pairs(_all_features(spark, sf)))


@query("structural_collinearity", sql(
    f"SELECT least(feature_a, feature_b) AS feature_a, greatest(feature_a, feature_b) AS feature_b, count(DISTINCT observation_date) AS n_months, {r6('avg(r)', 'avg_r')} "
    "FROM pairs GROUP BY 1, 2 HAVING count(DISTINCT observation_date) >= 5", **_COLLINEAR))
def _(spark, sf):
    """Seven months here, so five months take the place of eight out of twelve."""
    return rounded(validate.structural_pairs(validate.collinear_pairs(_all_features(spark, sf)), min_months=5))


_TRACKED = BEHAVIOURAL_FEATURES


@query("median_trajectory", sql(
    f"SELECT {when('observation_date', 'observation_date')}, feature, {r6('m', 'median_value')}, {r6('change', 'change')}, "
    "coalesce(change > 0.5, false) OR coalesce(before = 0 AND m <> 0, false) AS is_jump FROM (SELECT *, CASE WHEN before <> 0 THEN abs((m - before) / before) END AS change FROM "
    "(SELECT *, lag(m) OVER (PARTITION BY feature ORDER BY observation_date) AS before FROM (SELECT observation_date, feature, median(value) AS m FROM long GROUP BY 1, 2)))",
    long=_long(_TRACKED)))
def _(spark, sf):
    return rounded(validate.median_trajectory(stages.panel(spark, sf), _TRACKED))


def _edges(column: str) -> str:
    """Lower bounds of the ten equal-width bins, as a count of interior edges at or below the value; both with nine decimals."""
    return " + ".join(f"CASE WHEN value >= {half_even(f'lo + (hi - lo) / 10e0 * {i}', 9)} THEN 1 ELSE 0 END" for i in range(1, 10))


_PSI_EQUAL = f"""
 span AS (SELECT observation_date, feature, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
          CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM expected WHERE value IS NOT NULL GROUP BY 1, 2),
 e AS (SELECT observation_date, feature, {_edges('value')} AS bin, count(*) AS n FROM expected JOIN span USING (observation_date, feature) WHERE value IS NOT NULL GROUP BY 1, 2, 3),
 a AS (SELECT observation_date, feature, CASE WHEN value BETWEEN lo AND hi THEN {_edges('value')} END AS bin, count(*) AS n
       FROM actual JOIN span USING (observation_date, feature) WHERE value IS NOT NULL GROUP BY 1, 2, 3),
 et AS (SELECT observation_date, feature, sum(n) AS n FROM e GROUP BY 1, 2), tot AS (SELECT observation_date, feature, sum(n) AS n FROM a GROUP BY 1, 2),
 shares AS (SELECT t.observation_date, t.feature, greatest(coalesce(e.n, 0) / CAST(t.n AS DOUBLE), 1e-6) AS pe, greatest(coalesce(a.n, 0) / CAST(u.n AS DOUBLE), 1e-6) AS pa
       FROM et t JOIN tot u USING (observation_date, feature) CROSS JOIN range(10) r(bin)
       LEFT JOIN e ON e.observation_date = t.observation_date AND e.feature = t.feature AND e.bin = r.bin
       LEFT JOIN a ON a.observation_date = t.observation_date AND a.feature = t.feature AND a.bin = r.bin)"""


def _monthly_psi_sql(minimum: float) -> str:
    base = sql("SELECT 1 FROM long", long=_long(_TRACKED))
    head = base[: base.rindex("SELECT 1 FROM long")].rstrip()
    return (head + f",\n expected AS (SELECT member_id, observation_date + INTERVAL 1 MONTH AS observation_date, feature, {half_even('value', 9)} AS value FROM long),"
            f"\n actual AS (SELECT member_id, observation_date, feature, {half_even('value', 9)} AS value FROM long WHERE observation_date > (SELECT min(observation_date) FROM long))," + _PSI_EQUAL +
            f"\nSELECT {when('observation_date', 'observation_date')}, feature, {r6('sum((pe - pa) * ln(pe / pa))', 'psi')} FROM shares "
            f"GROUP BY observation_date, feature HAVING sum((pe - pa) * ln(pe / pa)) > {minimum}")


@query("equal_width_psi", _monthly_psi_sql(-1.0))
def _(spark, sf):
    """Every month against the one before, all values reported."""
    return rounded(validate.monthly_psi(stages.panel(spark, sf), _TRACKED, minimum=-1.0))


@query("monthly_psi_alerts", _monthly_psi_sql(0.005))
def _(spark, sf):
    """Only shifts above a limit; the months are alike, so the limit is low."""
    return rounded(validate.monthly_psi(stages.panel(spark, sf), _TRACKED, minimum=0.005))


_REPORT = ("SELECT observation_date, 0 AS n_missing, 0 AS n_range, "
           + " + ".join(f"CAST(count(*) FILTER (WHERE {c}) > 0 AS BIGINT)" for c in _RULES.values())
           + " + CAST(coalesce(avg(feature_complete) FILTER (WHERE purchase_count_180d = 0) > 0.3, false) AS BIGINT) AS n_sanity FROM features GROUP BY 1")


@query("validation_report", sql(
    f"SELECT {when('observation_date', 'observation_date')}, {big('n_missing', 'n_missing')}, {big('n_range', 'n_range')}, {big('n_sanity', 'n_sanity')}, n_sanity = 0 AS passed FROM ({_REPORT})"))
def _(spark, sf):
    return rounded(validate.validation_report(stages.panel(spark, sf)))


@query("validation_verdict", sql(f"SELECT count(*) AS n_months, count(*) FILTER (WHERE n_sanity = 0) AS n_passed, bool_and(n_sanity = 0) AS all_passed FROM ({_REPORT})"))
def _(spark, sf):
    return validate.overall_verdict(validate.validation_report(stages.panel(spark, sf)))
