"""Contact eligibility, drift, scoring outputs and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from memberlens.functions.exprs import lookup
from memberlens.operators import clean, contact, drift, outputs, segments
from memberlens.operators.features import BEHAVIOURAL_FEATURES, behavioural_features
from memberlens.operators.states import STATES as STATE_NAMES
from workload import stages
from workload.adapter import MONTHS, N_CLASSES, OBSERVED, SEGMENT_NAMES, raw_members
from workload.oracle import STATES, days, half_even
from workload.oracle import at_observed as sql_at
from workload.oracle import query as sql
from workload.q_scores import K, _RISK, _VALUES, _scored_test, _stored_risk
from workload.q_states import _CONFIDENCE, _EVIDENCE, segment_model
from workload.registry import big, query, r6, rounded, when

# --- eligibility -----------------------------------------------------------------------------

_PROFILE = """SELECT *, CASE WHEN is_closed THEN 'account_closed' WHEN is_fraud THEN 'fraud_flagged' WHEN n_channels_allowed = 0 THEN 'no_channel_consent' ELSE '' END AS suppression_reason,
 NOT is_closed AND NOT is_fraud AND n_channels_allowed > 0 AS is_targetable, is_dormant AND NOT is_closed AND NOT is_fraud AND n_channels_allowed > 0 AS needs_reactivation_track FROM
 (SELECT *, CAST(CAST(allow_email AS INTEGER) + CAST(allow_push AS INTEGER) + CAST(allow_sms AS INTEGER) AS BIGINT) AS n_channels_allowed FROM
 (SELECT member_id, account_status, lower(trim(account_status)) = 'closed' AS is_closed, lower(trim(account_status)) = 'dormant' AS is_dormant, coalesce(fraud_flag, false) AS is_fraud,
 coalesce(opt_in_email, false) AS allow_email, coalesce(opt_in_push, false) AS allow_push, coalesce(opt_in_sms, false) AS allow_sms FROM raw_members))"""


@query("contact_profile", sql("SELECT * FROM profile", profile=_PROFILE))
def _(spark, sf):
    return contact.contact_profile(raw_members(spark, sf))


def _order(*channels: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN allow_{c} THEN '{c}' END" for c in channels) + ", '')"


_CHANNEL = (f"CASE WHEN state_name IN ('Lapse Risk', 'Win-Back Target') THEN {_order('email', 'sms', 'push')} "
            f"WHEN state_name IN ('Silent Accumulator', 'Momentum Builder', 'Brand Advocate', 'New & Uncertain') THEN {_order('push', 'email', 'sms')} ELSE {_order('email', 'push', 'sms')} END")


def _case(column: str, table: dict, default: str) -> str:
    return f"CASE {column} " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in table.items()) + f" ELSE {default} END"


_ACTION = (f"CASE WHEN NOT is_targetable THEN concat('DO NOT CONTACT: ', {_case('suppression_reason', contact.REASON_TEXTS, chr(39) + 'Suppressed' + chr(39))}) "
           f"WHEN channel = '' THEN 'DO NOT CONTACT: no permitted channel for this state' "
           f"ELSE concat(CASE WHEN needs_reactivation_track THEN 'REACTIVATION TRACK | ' ELSE '' END, 'Channel: ', channel, ' | ', {_case('state_name', contact.STATE_MESSAGES, chr(39) + 'standard lifecycle message' + chr(39))}) END")
_RECOMMENDED = f"SELECT *, CASE WHEN is_targetable THEN channel ELSE '' END AS recommended_channel, {_ACTION} AS recommended_action FROM (SELECT *, {_CHANNEL} AS channel FROM joined_profile)"
_STATE_PROFILE = "SELECT p.*, s.state_name FROM states s JOIN profile p USING (member_id)"


def _state_profile(spark, sf):
    profile = contact.contact_profile(raw_members(spark, sf))
    return stages.observed_panel(spark, sf).select("member_id", "state_name").join(profile, "member_id")


@query("best_channel", sql_at("SELECT member_id, state_name, channel FROM recommended", profile=_PROFILE, joined_profile=_STATE_PROFILE, recommended=_RECOMMENDED))
def _(spark, sf):
    return _state_profile(spark, sf).select("member_id", "state_name", F.coalesce(contact.best_channel(F.col("state_name")), F.lit("")).alias("channel"))


@query("recommendation", sql_at("SELECT member_id, recommended_channel, recommended_action FROM recommended", profile=_PROFILE, joined_profile=_STATE_PROFILE, recommended=_RECOMMENDED))
def _(spark, sf):
    return contact.recommend(_state_profile(spark, sf)).select("member_id", "recommended_channel", "recommended_action")


@query("eligibility_summary", sql(
    "SELECT count(*) AS members, count(*) FILTER (WHERE is_targetable) AS targetable, count(*) FILTER (WHERE NOT is_targetable) AS suppressed, "
    + ", ".join(f"count(*) FILTER (WHERE suppression_reason = '{r}') AS {r}" for r in ("account_closed", "fraud_flagged", "no_channel_consent"))
    + ", count(*) FILTER (WHERE needs_reactivation_track) AS dormant_reactivation, " + ", ".join(f"count(*) FILTER (WHERE allow_{c}) AS allow_{c}" for c in ("email", "push", "sms")) + " FROM profile", profile=_PROFILE))
def _(spark, sf):
    return contact.eligibility_summary(contact.contact_profile(raw_members(spark, sf)))


_AGE = days(f"TIMESTAMP '{OBSERVED} 00:00:00'", "event_date")
_HISTORY = ("SELECT member_id, count(*) FILTER (WHERE age <= 30) AS contacts_30d, count(*) FILTER (WHERE age <= 90) AS contacts_90d, count(*) FILTER (WHERE age <= 180) AS contacts_180d, "
            "count(*) FILTER (WHERE age <= 180 AND answer IN ('opened', 'clicked')) AS responses_180d, count(*) FILTER (WHERE age <= 180 AND answer = 'clicked') AS clicks_180d, min(age) AS days_since_last_contact "
            f"FROM (SELECT member_id, {_AGE} AS age, lower(trim(campaign_response)) AS answer FROM evt WHERE campaign_id IS NOT NULL AND event_date <= TIMESTAMP '{OBSERVED} 00:00:00') GROUP BY 1")
_POP = "SELECT coalesce(sum(responses_180d) / nullif(CAST(sum(contacts_180d) AS DOUBLE), 0), 0) AS pop FROM history"
_RATED = ("SELECT *, (responses_180d + 20 * pop) / (contacts_180d + 20) AS smoothed, CASE WHEN pop > 0 THEN (responses_180d + 20 * pop) / (contacts_180d + 20) / pop ELSE 1 END AS multiplier FROM history, population")
_H = {"history": _HISTORY, "population": _POP, "rated": _RATED}


def _history(spark, sf):
    return contact.contact_history(stages.facts(spark, sf)[3], OBSERVED)


@query("contact_history", sql(f"SELECT *, {r6('responses_180d / nullif(CAST(contacts_180d AS DOUBLE), 0)', 'response_rate_raw')} FROM history", **_H))
def _(spark, sf):
    return rounded(_history(spark, sf))


@query("response_propensity", sql(f"SELECT member_id, {r6('pop', 'population_rate')}, {r6('smoothed', 'response_rate_smoothed')}, {r6('multiplier', 'response_multiplier')} FROM rated", **_H))
def _(spark, sf):
    return rounded(contact.response_propensity(_history(spark, sf)).select("member_id", "population_rate", "response_rate_smoothed", "response_multiplier"))


_CAPPED = ("SELECT p.* REPLACE (CASE WHEN is_targetable AND coalesce(contacts_30d, 0) >= 6 THEN 'frequency_cap' ELSE suppression_reason END AS suppression_reason, "
           "is_targetable AND coalesce(contacts_30d, 0) < 6 AS is_targetable), coalesce(contacts_30d, 0) AS contacts_30d, coalesce(contacts_90d, 0) AS contacts_90d, days_since_last_contact, "
           "coalesce(smoothed, pop2) AS smoothed, coalesce(multiplier, 1) AS multiplier FROM profile p LEFT JOIN rated USING (member_id), (SELECT pop AS pop2 FROM population)")


@query("frequency_cap", sql("SELECT member_id, is_targetable, suppression_reason FROM capped", profile=_PROFILE, capped=_CAPPED, **_H))
def _(spark, sf):
    profile = contact.contact_profile(raw_members(spark, sf)).join(_history(spark, sf).select("member_id", "contacts_30d"), "member_id", "left")
    return contact.frequency_cap(profile).select("member_id", "is_targetable", "suppression_reason")


_EFFECTIVE = "0.1e0 * greatest(0.25e0, least(2.5e0, multiplier))"


@query("effective_recovery_rate", sql(f"SELECT member_id, {r6(_EFFECTIVE, 'effective_recovery_rate')} FROM rated", **_H))
def _(spark, sf):
    rated = contact.response_propensity(_history(spark, sf))
    return rounded(rated.select("member_id", contact.effective_recovery(F.col("response_multiplier")).alias("effective_recovery_rate")))


_ELIGIBLE = "SELECT c.*, s.state_name FROM states s JOIN capped c USING (member_id)"
_E = {"profile": _PROFILE, "capped": _CAPPED, "joined_profile": _ELIGIBLE, "recommended": _RECOMMENDED, **_H}


def _eligibility(spark, sf):
    return contact.contact_eligibility(raw_members(spark, sf), stages.facts(spark, sf)[3], stages.observed_panel(spark, sf), OBSERVED)


@query("contact_eligibility", sql_at(
    "SELECT member_id, state_name, is_targetable, suppression_reason, needs_reactivation_track, allow_email, allow_push, allow_sms, contacts_30d, contacts_90d, days_since_last_contact, "
    f"{r6('smoothed', 'response_rate_smoothed')}, {r6('multiplier', 'response_multiplier')}, {r6(half_even(_EFFECTIVE, 4), 'effective_recovery_rate')}, recommended_channel, recommended_action FROM recommended", **_E))
def _(spark, sf):
    return rounded(_eligibility(spark, sf).drop("observation_date"))


@query("targeting_totals", sql_at("SELECT CASE suppression_reason WHEN '' THEN 'targetable' ELSE suppression_reason END AS reason, count(*) AS members FROM recommended GROUP BY 1", **_E))
def _(spark, sf):
    return outputs.targeting_totals(_eligibility(spark, sf))


@query("targeting_value_totals", sql_at(
    f"SELECT reason, members, {r6('value', 'value_at_risk', 4)}, {r6('coalesce(value / nullif(sum(value) OVER (), 0), 0)', 'value_share')} FROM (SELECT CASE suppression_reason WHEN '' THEN 'targetable' ELSE suppression_reason END AS reason, "
    "count(*) AS members, coalesce(sum(f.spend_total_180d), 0) / 10e0 AS value FROM recommended LEFT JOIN features f USING (member_id) GROUP BY 1)", **_E))
def _(spark, sf):
    """A tenth of the half-year's spend stands for the value at risk."""
    risk = stages.observed_panel(spark, sf).select("member_id", (F.col("spend_total_180d") / 10.0).alias("value_at_risk"))
    return rounded(rounded(outputs.targeting_value(_eligibility(spark, sf), risk).withColumn("value_at_risk", F.round("value_at_risk", 4))))


@query("recovery_rate_percentiles", sql_at(
    "SELECT " + ", ".join(r6(f"quantile_cont({half_even(_EFFECTIVE, 4)}, {q})", n) for n, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))) + " FROM recommended", **_E))
def _(spark, sf):
    return rounded(outputs.recovery_percentiles(_eligibility(spark, sf)))


# --- drift -----------------------------------------------------------------------------------------

_DRIFTING = (*behavioural_features(BEHAVIOURAL_FEATURES, "shipped"), "tenure_days", "return_count_7d")
_REF, _CUR = MONTHS[1], MONTHS[-1]


def _two_months(spark, sf):
    panel = stages.panel(spark, sf)
    return stages.month(panel, _REF), stages.month(panel, _CUR)


def _sample(date: str) -> str:
    columns = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _DRIFTING)
    return (f"SELECT feature, value FROM (UNPIVOT (SELECT {columns} FROM states WHERE observation_date = TIMESTAMP '{date} 00:00:00') "
            f"ON {', '.join(_DRIFTING)} INTO NAME feature VALUE value)")


_QUANTILES = ("SELECT feature, list_sort(list_distinct([" + ", ".join(f"quantile_cont(value, {i / 10})" for i in range(11)) + "])) AS edges FROM ref_rows GROUP BY 1")
_BINNED = ("SELECT feature, src, CASE WHEN len(edges) < 3 THEN 0 ELSE len(list_filter(edges[2:-2], lambda e: e <= value)) END AS bin, count(*) AS n FROM "
           "(SELECT *, 'r' AS src FROM ref_rows UNION ALL SELECT *, 'c' FROM cur_rows) JOIN edges_of USING (feature) GROUP BY 1, 2, 3")
_QPSI = ("SELECT feature, sum((pa - pe) * ln(pa / pe)) AS psi FROM (SELECT feature, bin, greatest(coalesce(sum(n) FILTER (WHERE src = 'r'), 0) / (sum(sum(n) FILTER (WHERE src = 'r')) OVER (PARTITION BY feature)), 1e-6) AS pe, "
         "greatest(coalesce(sum(n) FILTER (WHERE src = 'c'), 0) / (sum(sum(n) FILTER (WHERE src = 'c')) OVER (PARTITION BY feature)), 1e-6) AS pa FROM binned GROUP BY 1, 2) GROUP BY 1")
_KS = ("SELECT feature, max(abs(fr - fc)) AS ks, max(nr) AS nr, max(nc) AS nc FROM (SELECT feature, value, sum(r) OVER w / CAST(sum(r) OVER (PARTITION BY feature) AS DOUBLE) AS fr, sum(c) OVER w / CAST(sum(c) OVER (PARTITION BY feature) AS DOUBLE) AS fc, "
       "sum(r) OVER (PARTITION BY feature) AS nr, sum(c) OVER (PARTITION BY feature) AS nc FROM (SELECT feature, value, sum(r) AS r, sum(c) AS c FROM "
       "(SELECT feature, value, 1 AS r, 0 AS c FROM ref_rows UNION ALL SELECT feature, value, 0, 1 FROM cur_rows) GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature ORDER BY value)) GROUP BY 1")
_D = {"ref_rows": _sample(_REF), "cur_rows": _sample(_CUR), "edges_of": _QUANTILES, "binned": _BINNED, "qpsi": _QPSI, "ks_of": _KS}


@query("quantile_psi", sql(f"SELECT feature, {r6('psi', 'psi')} FROM qpsi", **_D))
def _(spark, sf):
    ref, cur = _two_months(spark, sf)
    return rounded(drift.quantile_psi(drift.ranked_pair(drift.paired_values(ref, cur, _DRIFTING))))


_P_VALUE = ("CASE WHEN lam < 0.2e0 THEN 1e0 ELSE least(1e0, greatest(0e0, list_sum(list_transform(range(1, 101), "
            "lambda j: CASE WHEN j % 2 = 1 THEN 2e0 ELSE -2e0 END * exp(-2e0 * j * j * lam * lam))))) END")


@query("ks_statistic", sql(f"SELECT feature, {r6('ks', 'ks_stat')}, {big('nr', 'n_reference')}, {big('nc', 'n_current')}, {r6(_P_VALUE, 'ks_pvalue')} "
                           "FROM (SELECT *, sqrt(CAST(nr AS DOUBLE) * nc / (nr + nc)) * ks AS lam FROM ks_of)", **_D))
def _(spark, sf):
    ref, cur = _two_months(spark, sf)
    stats = drift.ks_statistic(drift.ranked_pair(drift.paired_values(ref, cur, _DRIFTING)))
    return rounded(stats.withColumn("ks_pvalue", drift.ks_p_value(F.col("ks_stat"), F.col("n_reference"), F.col("n_current"))))


_REPORT = ("SELECT feature, psi, ks, CASE WHEN psi > 0.25 THEN 'ALERT' WHEN psi > 0.10 THEN 'WARN' ELSE 'ok' END AS status, (SELECT avg(value) FROM ref_rows r WHERE r.feature = qpsi.feature) AS rm, "
           "(SELECT avg(value) FROM cur_rows c WHERE c.feature = qpsi.feature) AS cm FROM qpsi JOIN ks_of USING (feature)")


@query("feature_drift_report", sql(f"SELECT feature, {r6('psi', 'psi')}, {r6('ks', 'ks_stat')}, status, {r6('rm', 'ref_mean')}, {r6('cm', 'cur_mean')} FROM drifted", drifted=_REPORT, **_D))
def _(spark, sf):
    ref, cur = _two_months(spark, sf)
    report = drift.feature_drift(ref, cur, _DRIFTING)
    return rounded(report.select("feature", "psi", "ks_stat", "status", "ref_mean", "cur_mean"))


def _shares(column: str) -> str:
    def month(d: str) -> str:
        return f"SELECT {column}, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM named WHERE observation_date = TIMESTAMP '{d} 00:00:00' GROUP BY 1"
    return f"SELECT coalesce(a.{column}, b.{column}) AS {column}, coalesce(a.share, 0) AS ref_share, coalesce(b.share, 0) AS cur_share FROM ({month(_REF)}) a FULL JOIN ({month(_CUR)}) b ON a.{column} = b.{column}"


@query("segment_mix_distance", sql(f"SELECT {r6('sum(abs(ref_share - cur_share)) / 2', 'tvd')} FROM shares", shares=_shares("segment_name")))
def _(spark, sf):
    ref, cur = _two_months(spark, sf)
    return rounded(drift.total_variation(drift.mix_shift(ref, cur, "segment_name")))


@query("state_mix_shift", sql(f"SELECT state_name, {r6('ref_share', 'ref_share')}, {r6('cur_share', 'cur_share')} FROM shares", shares=_shares("state_name")))
def _(spark, sf):
    ref, cur = _two_months(spark, sf)
    return rounded(drift.mix_shift(ref, cur, "state_name"))


@query("state_mix_distance", sql(f"SELECT {r6('sum(abs(ref_share - cur_share)) / 2', 'tvd')} FROM shares", shares=_shares("state_name")))
def _(spark, sf):
    ref, cur = _two_months(spark, sf)
    return rounded(drift.total_variation(drift.mix_shift(ref, cur, "state_name")))


def _frozen_quality(spark, sf, date: str) -> float:
    model = segment_model(spark, sf)
    assigned = model.assign(stages.month(stages.panel(spark, sf), date).drop("segment_id", "segment_name"), keep_point=True)
    return segments.quality(stages.stored(spark, sf, f"assigned_{date}", lambda: assigned.select("segment_id", "point")), "segment_id")["calinski_harabasz"]


@query("frozen_cluster_quality")
def _(spark, sf):
    """Calinski-Harabasz of both months under the frozen centroids."""
    a, b = _frozen_quality(spark, sf, MONTHS[3]), _frozen_quality(spark, sf, _CUR)
    return rounded(drift.quality_drop(spark, a, b))


def _rule_points(month):
    """Rule-based segments as clusters of spend, purchases and app use."""
    return month.select("segment_id", F.array(F.col("spend_total_30d") / 100.0, F.col("purchase_count_30d").cast("double"), F.col("app_open_30d").cast("double")).alias("point"))


def _ch(date: str) -> str:
    points = f"SELECT segment_id, spend_total_30d / 100e0 AS a, purchase_count_30d AS b, app_open_30d AS c FROM states WHERE observation_date = TIMESTAMP '{date} 00:00:00'"
    return (f"SELECT (sum(n * ((ma - ga) ** 2 + (mb - gb) ** 2 + (mc - gc) ** 2)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS ch FROM "
            f"(SELECT segment_id, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, (var_pop(a) + var_pop(b) + var_pop(c)) * count(*) AS w FROM ({points}) GROUP BY 1), "
            f"(SELECT avg(a) AS ga, avg(b) AS gb, avg(c) AS gc FROM ({points}))")


@query("drift_verdict", sql(
    "SELECT (SELECT feature FROM drifted ORDER BY psi DESC, feature DESC LIMIT 1) AS max_psi_feature, " + r6("(SELECT max(psi) FROM drifted)", "max_psi")
    + ", (SELECT count(*) FROM drifted WHERE status = 'ALERT') AS n_alert, (SELECT count(*) FROM drifted WHERE status = 'WARN') AS n_warn, " + r6("ch_drop", "ch_drop") + ", " + r6("s", "segment_mix_tvd") + ", " + r6("t", "state_mix_tvd")
    + ", CASE WHEN (SELECT count(*) FROM drifted WHERE status = 'ALERT') > 0 OR ch_drop > 0.2 OR s > 0.1 THEN 'RETRAIN_RECOMMENDED' WHEN (SELECT count(*) FROM drifted WHERE status = 'WARN') > 0 OR t > 0.1 THEN 'MONITOR' ELSE 'HEALTHY' END AS verdict "
      "FROM (SELECT sum(abs(ref_share - cur_share)) / 2 AS s FROM seg_shares), (SELECT sum(abs(ref_share - cur_share)) / 2 AS t FROM state_shares), (SELECT (a.ch - b.ch) / a.ch AS ch_drop FROM ref_quality a, cur_quality b)",
    ref_quality=_ch(_REF), cur_quality=_ch(_CUR), drifted=_REPORT, seg_shares=_shares("segment_name"), state_shares=_shares("state_name"), **_D))
def _(spark, sf):
    ref, cur = _two_months(spark, sf)
    report = drift.feature_drift(ref, cur, _DRIFTING)
    mixes = [drift.total_variation(drift.mix_shift(ref, cur, c)) for c in ("segment_name", "state_name")]
    qualities = [segments.quality(_rule_points(month), "segment_id")["calinski_harabasz"] for month in (ref, cur)]
    return rounded(drift.drift_verdict(report, *mixes, *qualities))


# --- outputs ------------------------------------------------------------------------------------------

# Frozen centroids over (spend of 90 days in hundreds, months since the last purchase), one per name.
_CENTRES = ((12.0, 0.3), (7.0, 0.6), (3.0, 1.2), (0.5, 3.5), (0.1, 33.0))


def _assigned(spark, sf):
    """Members assigned to the nearest frozen centroid."""
    panel = stages.observed_panel(spark, sf).drop("segment_id", "segment_name")
    point = F.array(F.col("spend_total_90d") / 100.0, F.coalesce(F.col("recency_days").cast("double"), F.lit(999.0)) / 30.0)
    found = segments.nearest_centroid(panel.withColumn("point", point), [list(c) for c in _CENTRES])
    return found.withColumn("segment_name", lookup(F.col("segment_id"), dict(enumerate(SEGMENT_NAMES))))


_NEAREST = ("SELECT member_id, observation_date, arg_min(id, d) AS segment_id, list_sort(list(d)) AS ds FROM (SELECT member_id, observation_date, id, "
            "sqrt((spend_total_90d / 100e0 - a) ** 2 + (coalesce(recency_days, 999) / 30e0 - b) ** 2) AS d FROM states, (VALUES "
            + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(_CENTRES)) + ") v(id, a, b)) GROUP BY 1, 2")
_GAP = half_even("greatest(0, least(1, (ds[2] - ds[1]) / (ds[2] + ds[1] + 1e-9)))", 4)


@query("segment_assignments", sql_at(
    f"SELECT member_id, {when('observation_date', 'observation_date')}, concat('S0', CAST(segment_id + 1 AS VARCHAR)) AS segment_id, {list(SEGMENT_NAMES)}[segment_id + 1] AS segment_name, "
    f"{r6(_GAP, 'segment_confidence')} FROM nearest", nearest=_NEAREST))
def _(spark, sf):
    return rounded(outputs.segment_assignments(_assigned(spark, sf)))


@query("state_assignments", sql_at(
    f"SELECT member_id, {when('observation_date', 'observation_date')}, state_name, {r6(_CONFIDENCE, 'state_confidence')}, CASE state_name "
    + " ".join(f"WHEN '{s}' THEN concat({', '.join(p)})" for s, p in _EVIDENCE.items()) + " END AS supporting_evidence FROM (SELECT * REPLACE (round(spend_slope_30d, 6) AS spend_slope_30d) FROM states)"))
def _(spark, sf):
    panel = stages.observed_panel(spark, sf).withColumn("spend_slope_30d", F.round("spend_slope_30d", 6))
    return rounded(outputs.state_assignments(panel))


@query("transition_predictions")
def _(spark, sf):
    return outputs.transition_predictions(_scored_test(spark, sf), N_CLASSES)


def _combined(spark, sf):
    cards = clean.cardholder_flags(raw_members(spark, sf))
    return stages.observed_panel(spark, sf).join(cards, "member_id", "left").na.fill(0, ["is_cardholder"])


_LONG = " UNION ALL ".join(f"SELECT segment_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM named WHERE {c} IS NOT NULL" for c in BEHAVIOURAL_FEATURES)
_Z = ("SELECT s.segment_id, feature, s.m, s.med, abs((s.m - o.m) / CASE WHEN o.sd IS NULL OR o.sd = 0 THEN 1 ELSE o.sd END) AS z FROM (SELECT segment_id, feature, avg(value) AS m, median(value) AS med FROM lng GROUP BY 1, 2) s "
      "JOIN (SELECT feature, avg(value) AS m, stddev_samp(value) AS sd FROM lng GROUP BY 1) o USING (feature)")


@query("segment_key_characteristics", sql_at(
    f"SELECT CAST(segment_id AS INTEGER) AS segment_id, CAST(rk AS INTEGER) AS rank, feature, {r6(half_even('m', 4), 'mean')}, {r6(half_even('med', 4), 'median')} FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY z DESC, feature) AS rk FROM zs) WHERE rk <= 5",
    lng=_LONG, zs=_Z))
def _(spark, sf):
    return rounded(outputs.key_characteristics(_combined(spark, sf), BEHAVIOURAL_FEATURES))


_CARD = "SELECT n.*, coalesce(CAST(m.credit_line IS NOT NULL AS INTEGER), 0) AS is_cardholder FROM named n LEFT JOIN raw_members m USING (member_id)"


@query("segment_sizes_and_cards", sql_at(
    f"SELECT CAST(segment_id AS INTEGER) AS segment_id, count(*) AS n_members, {r6(half_even('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100', 2), 'pct')}, "
    f"{r6(half_even('avg(is_cardholder) * 100', 2), 'cardholder_pct')}, {r6(half_even('100 - avg(is_cardholder) * 100', 2), 'non_cardholder_pct')} FROM cards GROUP BY 1", cards=_CARD))
def _(spark, sf):
    return rounded(outputs.segment_sizes(_combined(spark, sf)))


@query("segment_common_states", sql_at(
    "SELECT CAST(segment_id AS INTEGER) AS segment_id, state_name, n_members, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY n_members DESC, state_name) AS rk FROM "
    "(SELECT segment_id, state_name, count(*) AS n_members FROM named GROUP BY 1, 2)) WHERE rk <= 3"))
def _(spark, sf):
    return outputs.common_states(stages.observed_panel(spark, sf))


_TONED = " ".join(f"WHEN '{n}' THEN ' | Tone: {t}'" for n, t in outputs.SEGMENT_TONES.items())


@query("activation_texts", sql_at(
    "SELECT segment_name, state_name, coalesce(n, 0) AS n_members, CASE WHEN n IS NULL THEN concat('No members in ', segment_name, ' x ', state_name, ' combination') ELSE concat("
    + _case("state_name", outputs.ACTIVATIONS, "'Channel: email | Timing: monthly'") + f", CASE segment_name {_TONED} ELSE '' END) END AS activation FROM "
    f"(SELECT unnest({list(SEGMENT_NAMES)}) AS segment_name) CROSS JOIN (SELECT unnest({list(STATES)}) AS state_name) LEFT JOIN (SELECT segment_name, state_name, count(*) AS n FROM named GROUP BY 1, 2) USING (segment_name, state_name)"))
def _(spark, sf):
    return outputs.activation_texts(stages.observed_panel(spark, sf), SEGMENT_NAMES)


@query("segment_profiles")
def _(spark, sf):
    profiles = outputs.segment_profiles(_combined(spark, sf), BEHAVIOURAL_FEATURES, SEGMENT_NAMES)
    return profiles.select("segment_id", "segment_name", "n_members", "pct", F.to_json("key_characteristics").alias("key_characteristics"),
                           F.array_join("common_states", ", ").alias("common_states"), F.size("recommended_activation").alias("n_activations"))


_TOP = "list_position(proba, list_max(proba))"
_CODES = ", ".join(f"'S0{c + 1}'" for c in K)
_BAD = {
    "segment_assignments": f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT ({_GAP} BETWEEN 0 AND 1)) AS bad_confidence, count(*) FILTER (WHERE segment_id NOT BETWEEN 0 AND {N_CLASSES - 1}) AS bad_id FROM nearest",
    "state_assignments": f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT ({_CONFIDENCE} BETWEEN 0 AND 1)) AS bad_confidence, count(*) FILTER (WHERE state_name NOT IN {tuple(STATES)}) AS bad_id FROM states",
    "transition_predictions": "SELECT count(*) AS n_rows, count(*) FILTER (WHERE abs(list_sum(list_transform(proba, lambda p: round_even(p * 10000, 0) / 10000)) - 1) > 1e-3) AS bad_confidence, "
                              f"count(*) FILTER (WHERE seg_curr NOT BETWEEN 0 AND {N_CLASSES - 1} OR {_TOP} NOT BETWEEN 1 AND {N_CLASSES}) AS bad_id FROM scored",
}


@query("output_contracts", sql_at(" UNION ALL ".join(
    f"SELECT '{name}' AS output, n_rows, bad_confidence, bad_id, n_expected, n_rows = n_expected AND bad_confidence = 0 AND bad_id = 0 AS passed FROM ({checked}), "
    f"(SELECT count(*) AS n_expected FROM {'scored' if name == 'transition_predictions' else 'spine'})" for name, checked in _BAD.items()), nearest=_NEAREST))
def _(spark, sf):
    """All three outputs against their contracts."""
    _, spine, _, _ = stages.facts(spark, sf)
    codes = [f"S{c + 1:02d}" for c in K]
    scored = stages.scored(spark, sf).withColumn("seg_pred", (F.array_position("proba", F.array_max("proba")) - 1).cast("int"))
    checks = {
        "segment_assignments": (outputs.segment_assignments(_assigned(spark, sf)), spine, outputs.segment_rules(codes), ["confidence"]),
        "state_assignments": (outputs.state_assignments(stages.observed_panel(spark, sf)), spine, outputs.state_rules(), ["confidence"]),
        "transition_predictions": (outputs.transition_predictions(scored, N_CLASSES), scored, outputs.prediction_rules(codes), ["probability_sum"]),
    }
    out = None
    for name, (df, expected, rules, sure) in checks.items():
        checked = outputs.contract_check(df, expected, rules)
        total = lambda names: sum((F.col(f"bad_{n}") for n in names), F.lit(0))
        row = checked.select(F.lit(name).alias("output"), "n_rows", total(sure).cast("long").alias("bad_confidence"),
                             total([n for n in rules if n not in sure]).cast("long").alias("bad_id"), "n_expected", "passed")
        out = row if out is None else out.unionByName(row)
    return out


# --- questions on scored rows ------------------------------------------------------------------------------

_SCORED = {"vals": _VALUES, "risk": _RISK,
           "labelled": "SELECT r.*, s.state_no, ['" + "', '".join(SEGMENT_NAMES) + "'][r.seg_curr + 1] AS segment_name, ['" + "', '".join(SEGMENT_NAMES) + "'][list_position(r.proba, list_max(r.proba))] AS predicted_segment_name, "
                       "['" + "', '".join(STATES) + "'][s.state_no % 10 + 1] AS state_name FROM risk r JOIN (SELECT DISTINCT member_id, state_no FROM scored) s USING (member_id)"}


def _labelled_scores(spark, sf):
    names = F.array(*[F.lit(n) for n in SEGMENT_NAMES])
    states = F.array(*[F.lit(n) for n in STATE_NAMES])
    best = F.array_position("proba", F.array_max("proba"))
    return _stored_risk(spark, sf).withColumns({
        "segment_name": F.element_at(names, F.col("seg_curr") + 1), "predicted_segment_name": F.element_at(names, best.cast("int")),
        "state_name": F.element_at(states, (F.col("state_no") % 10 + 1).cast("int"))})


_WHERE = "WHERE segment_name = 'Growth Builder' AND state_name = 'Lapse Risk' AND predicted_segment_name = 'Growth Builder'"


@query("cohort_members", sql(
    f"SELECT member_id, segment_name, state_name, predicted_segment_name, {r6('adv', 'adverse_probability')}, {r6('var', 'value_at_risk')}, {r6('1 - proba[seg_curr + 1]', 'probability_of_moving')}, {r6('var', 'rank_score')} "
    f"FROM labelled {_WHERE} ORDER BY var DESC, member_id LIMIT 50", **_SCORED))
def _(spark, sf):
    chosen = outputs.cohort(_labelled_scores(spark, sf), "Growth Builder", "Lapse Risk", "Growth Builder")
    return rounded(outputs.cohort_members(chosen))


@query("cohort_totals", sql(f"SELECT count(*) AS matched, {r6('sum(var)', 'cohort_value_at_risk', 3)} FROM labelled {_WHERE}", **_SCORED))
def _(spark, sf):
    chosen = outputs.cohort(_labelled_scores(spark, sf), "Growth Builder", "Lapse Risk", "Growth Builder")
    return rounded(outputs.cohort_totals(chosen), 3)


@query("segment_catalogue", sql_at(
    f"SELECT CAST(row_number() OVER () AS INTEGER) AS position, segment_name, coalesce(n, 0) AS members, {r6('coalesce(n, 0) / CAST((SELECT count(*) FROM named) AS DOUBLE)', 'share')} FROM (SELECT unnest({[*SEGMENT_NAMES, 'Brand Advocate']}) AS segment_name) "
    "LEFT JOIN (SELECT segment_name, count(*) AS n FROM named GROUP BY 1) USING (segment_name)").replace("row_number() OVER ()", f"list_position({[*SEGMENT_NAMES, 'Brand Advocate']}, segment_name)"))
def _(spark, sf):
    """The last catalogue entry has no members."""
    return rounded(outputs.catalogue_distribution(stages.observed_panel(spark, sf), "segment_name", [*SEGMENT_NAMES, "Brand Advocate"]))


@query("state_catalogue", sql_at(
    f"SELECT CAST(list_position({list(STATES)}, state_name) AS INTEGER) AS position, state_name, coalesce(n, 0) AS members, {r6('coalesce(n, 0) / CAST((SELECT count(*) FROM named) AS DOUBLE)', 'share')} FROM (SELECT unnest({list(STATES)}) AS state_name) "
    "LEFT JOIN (SELECT state_name, count(*) AS n FROM named GROUP BY 1) USING (state_name)"))
def _(spark, sf):
    return rounded(outputs.catalogue_distribution(stages.observed_panel(spark, sf), "state_name", STATE_NAMES))


@query("single_member_view", sql_at("SELECT member_id, state_name, segment_name, " + r6("spend_total_90d", "spend_total_90d") + " FROM named WHERE member_id = 'MBR_0000042'"))
def _(spark, sf):
    return rounded(outputs.member_view(stages.observed_panel(spark, sf), "MBR_0000042").select("member_id", "state_name", "segment_name", "spend_total_90d"))


@query("review_sample")
def _(spark, sf):
    sample = outputs.review_sample(_labelled_scores(spark, sf), members=400)
    return rounded(sample.select("member_id", "segment_name", "state_name", "value_at_risk", "picked_by"))
