"""Sources, cleaning, referential integrity and the raw audit."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberlens.operators import audit, clean
from memberlens.operators.outputs import segment_assignments
from memberlens.session import checkpoint_dir
from memberlens.sources import tables
from workload import stages
from workload.adapter import DUCK, OBSERVED, members, raw_events, raw_members, raw_transactions, table
from workload.oracle import parsed
from workload.oracle import query as sql
from workload.registry import big, query, r6, rounded, when


def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


@query("parquet_scan", "SELECT o_orderstatus, count(*) AS n_rows, " + r6("sum(o_totalprice)", "total", 2) + " FROM orders GROUP BY 1")
def _(spark, sf):
    return rounded(table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_totalprice").alias("total")), 2)


@query("projected_scan", "SELECT count(DISTINCT o_custkey) AS n_members FROM orders")
def _(spark, sf):
    orders = tables.scan_parquet(spark, f"{sf}/orders.parquet", columns=["o_custkey"])
    return orders.distinct().agg(F.count(F.lit(1)).alias("n_members"))


@query("csv_round_trip", sql("SELECT member_id, account_status, coalesce(tier_history, '(null)') AS tier_history FROM raw_members"))
def _(spark, sf):
    path = _scratch(spark)
    tables.write_csv(raw_members(spark, sf).select("member_id", "account_status", "tier_history"), path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("member_id", "account_status", "tier_history")])
    return tables.scan_csv(spark, path, schema).withColumn("tier_history", F.coalesce("tier_history", F.lit("(null)")))


@query("monthly_parquet_sink", sql("SELECT strftime(observation_date, '%Y-%m-%d') AS observation_date, count(*) AS n_rows, "
                                   + r6("sum(spend_total_30d)", "spend", 3) + " FROM snapshot GROUP BY 1"))
def _(spark, sf):
    path = _scratch(spark)
    tables.write_monthly(stages.snapshots(spark, sf).select("member_id", "observation_date", "spend_total_30d"), path)
    stored = tables.read_monthly(spark, path)
    return rounded(stored.groupBy(F.date_format("observation_date", "yyyy-MM-dd").alias("observation_date")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("spend_total_30d").alias("spend")), 3)


@query("csv_output_sink", sql("SELECT segment_name, count(*) AS n_rows FROM named GROUP BY 1", dates=(OBSERVED,)))
def _(spark, sf):
    path = _scratch(spark)
    assigned = stages.observed_panel(spark, sf).withColumn("segment_confidence", F.lit(1.0))
    tables.write_csv(segment_assignments(assigned), path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("member_id", "observation_date", "segment_id", "segment_name", "segment_confidence")])
    return tables.scan_csv(spark, path, schema).groupBy("segment_name").agg(F.count(F.lit(1)).alias("n_rows"))


@query("json_report_sink", sql("SELECT state_name, count(*) AS n_rows FROM states GROUP BY 1", dates=(OBSERVED,)))
def _(spark, sf):
    path = _scratch(spark)
    counts = stages.observed_panel(spark, sf).groupBy("state_name").agg(F.count(F.lit(1)).alias("n_rows"))
    tables.write_json(counts, path)
    return tables.read_report(spark, path, counts.schema)


@query("incremental_snapshot_reuse", sql(
    "SELECT strftime(observation_date, '%Y-%m-%d') AS observation_date, count(*) AS n_rows, "
    + big("sum(purchase_count_30d)", "purchases") + " FROM snapshot GROUP BY 1", dates=("2023-12-31", OBSERVED)))
def _(spark, sf):
    """The prior month is stored first; the second call builds only the missing date."""
    path = _scratch(spark)

    def build(dates):
        return stages.fresh_snapshots(spark, sf, dates).select("member_id", "observation_date", "purchase_count_30d")

    inputs = [f"{sf}/{t}.parquet" for t in ("customer", "orders", "events")]
    tables.build_missing(spark, path, [tables.prior_month(OBSERVED)], build, inputs)
    both = tables.build_missing(spark, path, [tables.prior_month(OBSERVED), OBSERVED], build, inputs)
    return both.groupBy(F.date_format("observation_date", "yyyy-MM-dd").alias("observation_date")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("purchase_count_30d").alias("purchases"))


# --- cleaning -----------------------------------------------------------------------------

@query("multi_format_timestamps", sql("SELECT transaction_id, " + when(parsed("transaction_date"), "transaction_date") + " FROM raw_transactions"))
def _(spark, sf):
    return rounded(clean.parse_timestamps(raw_transactions(spark, sf), ["transaction_date"]).select("transaction_id", "transaction_date"))


@query("normalised_categories", sql(
    "SELECT lower(trim(transaction_type)) AS transaction_type, lower(trim(channel)) AS channel, lower(trim(merchant_category)) AS merchant_category, "
    "count(*) AS n_rows FROM raw_transactions GROUP BY 1, 2, 3"))
def _(spark, sf):
    columns = ["transaction_type", "channel", "merchant_category"]
    return clean.normalise_text(raw_transactions(spark, sf), columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))


@query("event_dedup", sql(f"SELECT member_id, {when('event_date', 'event_date')}, event_type, event_channel, event_no, {r6('session_duration_sec', 'session_duration_sec', 3)} FROM clean_evt"))
def _(spark, sf):
    """Whole chain: normalise, parse, keep the first copy, cap the duration."""
    events = clean.clean_events(raw_events(spark, sf), ["event_no"])
    return rounded(events.select("member_id", "event_date", "event_type", "event_channel", "event_no", "session_duration_sec"), 3)


@query("capped_sessions", sql(
    "SELECT event_no, " + r6("CASE WHEN session_duration_sec IS NOT NULL THEN least(session_duration_sec, 14400) END", "session_duration_sec", 3) + " FROM raw_events"))
def _(spark, sf):
    return rounded(clean.cap_sessions(raw_events(spark, sf)).select("event_no", "session_duration_sec"), 3)


_BOUNDS = {"spend_total_30d": (0.0, 500.0), "avg_order_value_30d": (None, 300.0), "hoarding_ratio": (0.0, 10.0),
           "browse_to_purchase_ratio_30d": (0.0, 10.0), "not_a_column": (0.0, 1.0)}


@query("outlier_clips", sql(
    "SELECT member_id, " + ", ".join([r6("greatest(0, least(500, spend_total_30d))", "spend_total_30d"), r6("least(300, avg_order_value_30d)", "avg_order_value_30d"),
                                      r6("hoarding_ratio", "hoarding_ratio"), r6("browse_to_purchase_ratio_30d", "browse_to_purchase_ratio_30d")])
    + " FROM features", dates=(OBSERVED,)))
def _(spark, sf):
    clipped = clean.clip_to_bounds(stages.observed_panel(spark, sf), _BOUNDS)
    return rounded(clipped.select("member_id", *[c for c in _BOUNDS if c in clipped.columns]))


_ORPHANS = ("SELECT DISTINCT member_id FROM (SELECT member_id FROM raw_transactions UNION SELECT member_id FROM raw_events) "
            "WHERE member_id NOT IN (SELECT member_id FROM raw_members)")


@query("tagged_ghosts", sql("SELECT DISTINCT member_id FROM raw_members WHERE member_id LIKE 'MBR_GHOST_%'"))
def _(spark, sf):
    return clean.tagged_ghosts(raw_members(spark, sf))


@query("orphan_ids", sql(_ORPHANS))
def _(spark, sf):
    return clean.orphan_ids(raw_members(spark, sf), raw_transactions(spark, sf), raw_events(spark, sf))


@query("orphan_breakdown", sql(
    "SELECT CASE WHEN e.member_id IS NULL THEN 'transactions_only' WHEN t.member_id IS NULL THEN 'events_only' ELSE 'both' END AS found_in, count(*) AS n_ids "
    "FROM (SELECT DISTINCT member_id FROM raw_transactions) t FULL JOIN (SELECT DISTINCT member_id FROM raw_events) e ON t.member_id = e.member_id "
    "WHERE coalesce(t.member_id, e.member_id) NOT IN (SELECT member_id FROM raw_members) GROUP BY 1"))
def _(spark, sf):
    return clean.orphan_breakdown(raw_members(spark, sf), raw_transactions(spark, sf), raw_events(spark, sf))


_GHOSTS = f"SELECT member_id FROM raw_members WHERE member_id LIKE 'MBR_GHOST_%' UNION ALL ({_ORPHANS})"


def _ghosts(spark, sf):
    return clean.ghost_ids(raw_members(spark, sf), raw_transactions(spark, sf), raw_events(spark, sf))


@query("ghost_exclusion", sql(f"SELECT lower(trim(transaction_type)) AS transaction_type, count(*) AS n_rows FROM raw_transactions WHERE member_id NOT IN ({_GHOSTS}) GROUP BY 1"))
def _(spark, sf):
    kept = clean.exclude_ids(raw_transactions(spark, sf), _ghosts(spark, sf))
    return clean.normalise_text(kept, ["transaction_type"]).groupBy("transaction_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query("guest_cohort", sql(f"SELECT transaction_id, member_id, {r6('transaction_amount', 'transaction_amount')} FROM raw_transactions WHERE member_id IN ({_GHOSTS})"))
def _(spark, sf):
    return rounded(clean.only_ids(raw_transactions(spark, sf), _ghosts(spark, sf)).select("transaction_id", "member_id", "transaction_amount"))


@query("member_spine", sql(f"SELECT member_id, {when('account_open_date', 'account_open_date')} FROM spine"))
def _(spark, sf):
    return rounded(clean.build_spine(raw_members(spark, sf), _ghosts(spark, sf)))


@query("duplicate_keys", sql("SELECT member_id, event_type, count(*) AS n_rows FROM raw_events GROUP BY 1, 2 HAVING count(*) > 1"))
def _(spark, sf):
    clean.assert_unique(raw_members(spark, sf), ["member_id"])
    return clean.duplicate_keys(raw_events(spark, sf), ["member_id", "event_type"])


@query("spine_ghost_overlap", sql(f"SELECT count(*) AS n_shared FROM (SELECT member_id FROM spine INTERSECT SELECT member_id FROM ({_GHOSTS}))"))
def _(spark, sf):
    spine = clean.build_spine(raw_members(spark, sf))
    return clean.shared_ids(spine, _ghosts(spark, sf)).agg(F.count(F.lit(1)).alias("n_shared"))


@query("zero_activity_members", sql(
    "SELECT member_id, " + when("account_open_date", "account_open_date")
    + " FROM spine WHERE member_id NOT IN (SELECT member_id FROM raw_transactions UNION SELECT member_id FROM raw_events)"))
def _(spark, sf):
    spine = clean.build_spine(raw_members(spark, sf))
    return rounded(clean.inactive_members(spine, raw_transactions(spark, sf), raw_events(spark, sf)).select("member_id", "account_open_date"))


@query("activity_summary", sql(
    "SELECT count(*) AS total_members, count(*) FILTER (WHERE t) AS members_with_transactions, count(*) FILTER (WHERE e) AS members_with_engagement, "
    "count(*) FILTER (WHERE t OR e) AS members_with_any_activity, count(*) FILTER (WHERE NOT t AND NOT e) AS zero_activity_members FROM "
    "(SELECT member_id IN (SELECT member_id FROM raw_transactions) AS t, member_id IN (SELECT member_id FROM raw_events) AS e FROM spine)"))
def _(spark, sf):
    return clean.activity_summary(clean.build_spine(raw_members(spark, sf)), raw_transactions(spark, sf), raw_events(spark, sf))


@query("cardholder_flags", sql("SELECT member_id, " + big("credit_line IS NOT NULL", "is_cardholder") + " FROM raw_members WHERE member_id NOT LIKE 'MBR_GHOST_%'"))
def _(spark, sf):
    return clean.cardholder_flags(raw_members(spark, sf))


# --- audit -----------------------------------------------------------------------------------

@query("table_profile")
def _(spark, sf):
    return audit.table_profile(raw_members(spark, sf)).withColumn("samples", F.array_join("samples", " | "))


@query("monthly_profile_merge")
def _(spark, sf):
    """Sketches of the transactions of every month, merged to the profile of the whole table."""
    parsed = clean.parse_timestamps(raw_transactions(spark, sf), ["transaction_date"])
    monthly = audit.column_sketches(parsed.withColumn("month", F.date_format("transaction_date", "yyyy-MM")), by=["month"])
    return audit.merged_profile(monthly).withColumn("samples", F.array_join("samples", " | "))


@query("row_counts", "SELECT table_name, actual, " + big("expected", "expected") + ", " + r6("pct", "pct_diff")
       + ", CASE WHEN pct > 5 THEN 'WARNING' ELSE 'OK' END AS flag FROM (SELECT *, abs(actual - expected) / CAST(expected AS DOUBLE) * 100 AS pct FROM ("
       "SELECT 'customer' AS table_name, count(*) AS actual, 1500 AS expected FROM customer UNION ALL "
       "SELECT 'orders', count(*), 14000 FROM orders UNION ALL SELECT 'events', count(*), 9900 FROM events))")
def _(spark, sf):
    expected = {"customer": 1500, "orders": 14000, "events": 9900}
    return rounded(audit.row_counts({n: (table(spark, sf, n), e) for n, e in expected.items()}))


@query("id_format_masks", sql(
    "SELECT mask, n_rows, " + r6("n_rows / CAST(sum(n_rows) OVER () AS DOUBLE)", "share") + ", row_number() OVER (ORDER BY n_rows DESC, mask) = 1 AS is_dominant "
    "FROM (SELECT regexp_replace(member_id, '[0-9]', '#', 'g') AS mask, count(*) AS n_rows FROM raw_transactions GROUP BY 1)"))
def _(spark, sf):
    return rounded(audit.id_masks(raw_transactions(spark, sf)))


_AUDITED = tuple(members(DUCK))


@query("null_rates", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, {r6(f'(count(*) - count({c})) / CAST(count(*) AS DOUBLE) * 100', 'null_pct')} FROM raw_members"
    for c in _AUDITED)))
def _(spark, sf):
    return rounded(audit.null_rates(raw_members(spark, sf)))


@query("date_format_census", sql(
    "SELECT 'transaction_date' AS column_name, count(transaction_date) AS n_values, count(*) FILTER (WHERE regexp_matches(transaction_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS iso_count, "
    "count(*) FILTER (WHERE regexp_matches(transaction_date, '^[0-9]{2}/[0-9]{2}/[0-9]{4}')) AS day_first_count, true AS is_mixed FROM raw_transactions"))
def _(spark, sf):
    return audit.date_format_census(raw_transactions(spark, sf), "transaction_date")


@query("json_parseability", sql(
    "SELECT count(*) AS n_total, count(*) FILTER (WHERE tier_history IS NULL) AS n_null, count(*) FILTER (WHERE json_valid(tier_history)) AS n_valid, "
    "count(*) FILTER (WHERE tier_history IS NOT NULL AND NOT json_valid(tier_history)) AS n_failure FROM raw_members"))
def _(spark, sf):
    return audit.json_parseability(raw_members(spark, sf))


_KEY_COUNTS = "SELECT member_id, event_date, lower(trim(event_type)) AS event_type, count(*) AS n_rows FROM raw_events GROUP BY 1, 2, 3 HAVING count(*) > 1"


@query("duplicate_key_audit", sql(f"SELECT count(*) AS n_duplicate_keys, {big('coalesce(sum(n_rows), 0)', 'n_duplicate_rows')} FROM ({_KEY_COUNTS})"))
def _(spark, sf):
    return audit.duplicate_audit(clean.normalise_text(raw_events(spark, sf), ["event_type"]))


@query("worst_duplicates", sql(f"SELECT * FROM ({_KEY_COUNTS}) ORDER BY n_rows DESC, member_id, event_date, event_type LIMIT 500"))
def _(spark, sf):
    return audit.worst_duplicates(clean.normalise_text(raw_events(spark, sf), ["event_type"]))


@query("session_distribution", sql(
    "SELECT count(v) AS n_values, " + ", ".join([
        r6("avg(v)", "mean_value"), r6("max(v)", "max_value"), "count(*) FILTER (WHERE v > 14400) AS over_4h", "count(*) FILTER (WHERE v > 28800) AS over_8h",
        *[r6(f"quantile_cont(v, {q / 100})", f"p{q}") for q in (50, 90, 95, 99)]])
    + ", CAST(14400 AS DOUBLE) AS clip_upper FROM (SELECT session_duration_sec AS v FROM raw_events)"))
def _(spark, sf):
    return rounded(audit.session_distribution(raw_events(spark, sf)))


@query("amount_bounds", sql(
    "SELECT " + ", ".join([r6("min(v)", "min_value"), r6("max(v)", "max_value"), "count(*) FILTER (WHERE v < 0) AS n_negative", "count(*) FILTER (WHERE v = 0) AS n_zero",
                           r6("quantile_cont(v, 0.01)", "p01"), r6("quantile_cont(v, 0.99)", "p99")]) + " FROM (SELECT transaction_amount AS v FROM raw_transactions)"))
def _(spark, sf):
    return rounded(audit.amount_bounds(raw_transactions(spark, sf)))


@query("category_distribution", sql(
    "SELECT stage, category, n_rows, " + r6("n_rows / CAST(sum(n_rows) OVER (PARTITION BY stage) AS DOUBLE)", "share") + " FROM ("
    "SELECT 'raw' AS stage, transaction_type AS category, count(*) AS n_rows FROM raw_transactions GROUP BY 2 UNION ALL "
    "SELECT 'normalised', lower(trim(transaction_type)), count(*) FROM raw_transactions GROUP BY 2)"))
def _(spark, sf):
    return rounded(audit.category_distribution(raw_transactions(spark, sf)))
