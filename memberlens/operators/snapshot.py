"""As-of snapshots: one row per member and observation date, any number of dates in one pass.

How the work is laid out
* Each fact row is sent to the observation dates that can see it: the dates are a
  sorted literal list, the first visible one is found by a binary CASE, and the
  following ones within the longest window come from `slice`. No join, no pair
  list; a row is repeated at most as often as windows overlap.
* Fact rows are dealt by member when they meet the spine, narrow as they are and once
  each. Everything after that - aggregates per member and date, their joins, the months of
  a member - finds its rows in place. The parts of a member with a third of all rows
  are split by AQE and reduced to one partial row per date before an exchange of their own.
* All windows are conditional aggregates of one grouping.
* Distinct counts do not merge that way. They are taken from the latest date per
  (member, date, value), which needs two rows per fact instead of the nine that
  eight separate distinct counts would expand to.
* Lifetime sums use the first visible date only and are accumulated per member.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.functions.exprs import MICROS_PER_DAY, count_where, elapsed_days, half_even, sum_where, ts
from memberlens.operators.tier import parsed_history, tier_columns
from memberlens.schema import EVENT_TYPES, WINDOW_DAYS

REACH_DAYS = max(WINDOW_DAYS)
SLOPE_DAYS = 30


# --- which observation dates see a row ------------------------------------------

def sorted_dates(dates: Sequence[str]) -> list[str]:
    return sorted({str(d)[:10] for d in dates})


def first_visible(date: Column, dates: Sequence[str]) -> Column:
    """Position from 1 of the first observation date at or after `date`; len + 1 if there is none."""

    def split(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low + 1)
        middle = (low + high) // 2
        return F.when(date <= ts(dates[middle]), split(low, middle)).otherwise(split(middle + 1, high))

    return split(0, len(dates))


def _overlap(dates: Sequence[str], reach_days: int) -> int:
    """Most observation dates that can see one row within `reach_days`."""
    import pandas as pd

    days = pd.to_datetime(list(dates))
    return max(int(((days >= d) & (days <= d + pd.Timedelta(days=reach_days))).sum()) for d in days)


def _within(days: int, age: str = "_age") -> Column:
    return F.col(age) <= F.lit(days * MICROS_PER_DAY)


def at_dates(facts: DataFrame, date_column: str, dates: Sequence[str], reach_days: int = REACH_DAYS) -> DataFrame:
    """Repeat every row for each observation date that sees it within `reach_days` (both ends included).

    `_age` is the time between the two in microseconds: windows become plain
    comparisons of longs, without calendar arithmetic per row and window.
    """
    dates = sorted_dates(dates)
    when = F.col(date_column)
    near = facts.where((when <= ts(dates[-1])) & (when >= ts(dates[0]) - F.expr(f"INTERVAL {reach_days} DAYS")))
    seen = F.slice(F.array(*[ts(d) for d in dates]), first_visible(when, dates), _overlap(dates, reach_days))
    return (near.withColumn("observation_date", F.explode(seen))
            .withColumn("_age", F.unix_micros("observation_date") - F.unix_micros(when))
            .where(_within(reach_days)))


def as_of(facts: DataFrame, date_column: str, date: str) -> DataFrame:
    return facts.where(F.col(date_column) <= ts(date))


# --- enrolment and leakage ------------------------------------------------------

def with_enrolment(facts: DataFrame, spine: DataFrame) -> DataFrame:
    """Attach account_open_date. Rows of ids that are not on the spine drop out here.

    Rows come out dealt by member, also where the spine could be broadcast: aggregates per member and date repeat a row for
    every date that sees it and would otherwise send these.
    """
    return facts.join(spine.select("member_id", "account_open_date").hint("merge"), "member_id")


def after_enrolment(facts: DataFrame, spine: DataFrame, date_column: str) -> DataFrame:
    return with_enrolment(facts, spine).where(F.col(date_column) >= F.col("account_open_date"))


def _require(df: DataFrame, *columns: str) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"missing column(s): {absent}")


def future_rows(df: DataFrame, date_column: str, date: str) -> DataFrame:
    """Count, latest date and a few member ids of rows after the observation date."""
    _require(df, date_column)
    late = F.col(date_column) > ts(date)
    who = F.col("member_id") if "member_id" in df.columns else F.lit(None).cast("string")
    return df.agg(count_where(late).alias("n_violations"), F.max(F.when(late, F.col(date_column))).alias("latest"),
                  F.min(F.when(late, who)).alias("example_member"))


def assert_no_future(df: DataFrame, date_column: str, date: str, context: str = "") -> None:
    found = future_rows(df, date_column, date).first()
    if found.n_violations:
        raise AssertionError(f"{context}: {found.n_violations} rows after {date}, latest {found.latest}, "
                             f"e.g. member {found.example_member}")


def early_rows(df: DataFrame, date_column: str, enrolment_column: str) -> DataFrame:
    _require(df, date_column, enrolment_column)
    early = F.col(date_column) < F.col(enrolment_column)
    return df.agg(count_where(early).alias("n_violations"), F.min(F.when(early, F.col("member_id"))).alias("example_member"))


def assert_enrolled(df: DataFrame, date_column: str, enrolment_column: str = "account_open_date",
                    context: str = "") -> None:
    found = early_rows(df, date_column, enrolment_column).first()
    if found.n_violations:
        raise AssertionError(f"{context}: {found.n_violations} rows before enrolment, e.g. member {found.example_member}")


# --- aggregates per (member, observation date) ------------------------------------

def _weeks(days: int) -> int:
    """Calendar weeks a span of `days` can touch."""
    return (days + 6) // 7 + 1


def _monday_week(date: Column) -> Column:
    """Running number of the Monday-based week; 1970-01-01 was a Thursday."""
    return F.floor((F.unix_date(F.to_date(date)) + 3) / 7).cast("int")


def with_week(seen: DataFrame, days: int = SLOPE_DAYS) -> DataFrame:
    """`_week`: Monday weeks between a purchase of the trend window and the observation date, else null."""
    weeks = _monday_week(F.col("observation_date")) - _monday_week(F.col("transaction_date"))
    return seen.withColumn("_week", F.when((F.col("transaction_type") == "purchase") & _within(days), weeks))


def weekly_aggregates(days: int = SLOPE_DAYS) -> list[Column]:
    """Spend and count per calendar week of the trend window, as aggregate columns."""
    aggs = []
    for week in range(_weeks(days)):
        here = F.col("_week") == week
        aggs.append(sum_where(here, F.col("transaction_amount")).alias(f"_wspend_{week}"))
        aggs.append(count_where(here).alias(f"_wcount_{week}"))
    return aggs


def with_slopes(weekly: DataFrame, days: int = SLOPE_DAYS) -> DataFrame:
    """Least-squares slopes over the weeks that have purchases, oldest first; 0 for fewer than two weeks.

    A week's place on the x axis is the number of older weeks with purchases.
    Plain arithmetic on the week columns keeps the step in generated code.
    """
    oldest_first = range(_weeks(days) - 1, -1, -1)
    active = {w: F.when(F.col(f"_wcount_{w}") > 0, 1).otherwise(0) for w in oldest_first}
    places, seen = {}, F.lit(0)
    for w in oldest_first:
        places[f"_wplace_{w}"] = seen
        seen = seen + active[w]
    placed = weekly.withColumns({**places, "_wn": seen.cast("double")})
    n = F.col("_wn")
    mean_x, sxx = (n - 1) / 2.0, n * (n * n - 1.0) / 12.0

    def slope(value: str) -> Column:
        # weeks without purchases have value 0 and add nothing
        sxy = sum([(F.col(f"_wplace_{w}") - mean_x) * F.coalesce(F.col(f"{value}_{w}").cast("double"), F.lit(0.0)) for w in oldest_first], F.lit(0.0))
        # sums of amounts differ in the last bits with the order of rows: rounded, equal slopes are equal numbers
        return F.when(n >= 2, half_even(sxy / sxx, 9)).otherwise(F.lit(0.0))

    out = placed.withColumns({"spend_slope_30d": slope("_wspend"), "frequency_slope_30d": slope("_wcount")})
    return out.drop(*[c for c in out.columns if c.startswith("_w")])


def weekly_slopes(transactions: DataFrame, dates: Sequence[str], days: int = SLOPE_DAYS) -> DataFrame:
    """Weekly spend and frequency trend per (member, date). Not restricted to activity after enrolment."""
    seen = at_dates(transactions.where(F.col("transaction_type") == "purchase"), "transaction_date", dates, days)
    weekly = with_week(seen, days).groupBy("member_id", "observation_date").agg(*weekly_aggregates(days))
    return with_slopes(weekly, days)


def transaction_windows(enrolled: DataFrame, dates: Sequence[str], windows: Sequence[int] = WINDOW_DAYS) -> DataFrame:
    """Window sums and counts plus the weekly trend, one grouping for all of them.

    `enrolled` carries account_open_date: the windows skip earlier rows, the trend does not.
    """
    live = F.col("transaction_date") >= F.col("account_open_date")
    kind = F.col("transaction_type")
    # ages by row kind: null where the row does not count, so one comparison decides per window
    seen = with_week(at_dates(enrolled, "transaction_date", dates, max(windows))).withColumns({
        "_live": F.when(live, F.col("_age")),
        "_bought": F.when(live & (kind == "purchase"), F.col("_age")),
        "_returned": F.when(live & (kind == "return"), F.col("_age"))})
    aggs = []
    for days in windows:
        bought = _within(days, "_bought")
        aggs += [
            # rounded as slopes are: a spend limit must not depend on the order of rows
            half_even(sum_where(bought, F.col("transaction_amount")), 9).alias(f"spend_total_{days}d"),
            count_where(bought).alias(f"purchase_count_{days}d"),
            count_where(_within(days, "_returned")).alias(f"return_count_{days}d"),
            sum_where(_within(days, "_live"), F.col("points_earned")).alias(f"points_earned_{days}d"),
        ]
    weekly = seen.groupBy("member_id", "observation_date").agg(*aggs, *weekly_aggregates())
    return with_slopes(weekly)


def transaction_diversity(enrolled: DataFrame, dates: Sequence[str], windows: Sequence[int] = WINDOW_DAYS) -> DataFrame:
    """Distinct categories (purchases) and channels (all types) per window."""
    live = enrolled.where(F.col("transaction_date") >= F.col("account_open_date"))
    marks = F.array(
        F.struct(F.lit("categories").alias("kind"),
                 F.when(F.col("transaction_type") == "purchase", F.col("merchant_category")).alias("mark")),
        F.struct(F.lit("channels").alias("kind"), F.col("channel").alias("mark")))
    seen = at_dates(live, "transaction_date", dates, max(windows))
    latest = (seen.select("member_id", "observation_date", "_age", F.explode(marks).alias("m"))
              .select("member_id", "observation_date", "_age", "m.kind", "m.mark")
              .where(F.col("mark").isNotNull())
              .groupBy("member_id", "observation_date", "kind", "mark")
              .agg(F.min("_age").alias("_age")))
    aggs = [count_where((F.col("kind") == kind) & _within(days)).alias(f"unique_{kind}_{days}d")
            for days in windows for kind in ("categories", "channels")]
    return latest.groupBy("member_id", "observation_date").agg(*aggs)


def event_windows(events: DataFrame, dates: Sequence[str], windows: Sequence[int] = WINDOW_DAYS,
                  event_types: Sequence[str] = EVENT_TYPES) -> DataFrame:
    """Counts by event type and session seconds per window. Types that do not occur count 0."""
    seen = at_dates(events, "event_date", dates, max(windows))
    aggs = []
    for days in windows:
        here = _within(days)
        aggs += [count_where(here & (F.col("event_type") == t)).alias(f"{t}_{days}d") for t in event_types]
        aggs.append(sum_where(here, F.col("session_duration_sec")).alias(f"total_session_sec_{days}d"))
    return seen.groupBy("member_id", "observation_date").agg(*aggs)


def lifetime_history(live: DataFrame, dates: Sequence[str]) -> DataFrame:
    """Per member, the points and last date that become visible at each observation date.

    The list has at most one entry per observation date.
    """
    dates = sorted_dates(dates)
    when = F.col("transaction_date")
    steps = (live.where(when <= ts(dates[-1]))
             .groupBy("member_id", first_visible(when, dates).alias("step"))
             .agg(F.sum("points_earned").alias("earned"), F.sum("points_clawed_back").alias("clawed"),
                  F.max(when).alias("last_date")))
    return steps.groupBy("member_id").agg(
        F.collect_list(F.struct("step", "earned", "clawed", "last_date")).alias("_steps"))


def _until(steps: Column, position: Column) -> Column:
    return F.filter(F.coalesce(steps, F.array()), lambda s: s["step"] <= position)


def lifetime_columns(steps: Column, position: Column) -> dict[str, Column]:
    seen = _until(steps, position)

    def total(field: str) -> Column:
        return F.aggregate(seen, F.lit(0).cast("long"), lambda acc, s: acc + F.coalesce(s[field], F.lit(0)))

    return {
        "points_earned_lifetime": total("earned"),
        "points_clawed_back_lifetime": total("clawed"),
        "last_transaction_date": F.array_max(F.transform(seen, lambda s: s["last_date"])),
    }


def member_dates(spine: DataFrame, dates: Sequence[str]) -> DataFrame:
    """The fixed panel: every spine member at every observation date, with the date's position."""
    literal = F.array(*[ts(d) for d in sorted_dates(dates)])
    return spine.select("*", F.posexplode(literal).alias("_p", "observation_date")).withColumn("_p", F.col("_p") + 1)


def count_columns(windows: Sequence[int] = WINDOW_DAYS, event_types: Sequence[str] = EVENT_TYPES) -> list[str]:
    names = []
    for days in windows:
        names += [f"spend_total_{days}d", f"purchase_count_{days}d", f"unique_categories_{days}d",
                  f"unique_channels_{days}d", f"return_count_{days}d", f"points_earned_{days}d"]
        names += [f"{t}_{days}d" for t in event_types]
        names.append(f"total_session_sec_{days}d")
    return names


def build_snapshots(spine: DataFrame, transactions: DataFrame, events: DataFrame, members: DataFrame,
                    dates: Sequence[str]) -> DataFrame:
    """Snapshots of all spine members at all dates, from cleaned facts.

    Zero-activity members stay; counts and sums are 0 for them and recency is null.
    The trend columns of the feature set come along because they share the scan.
    """
    enrolled = with_enrolment(transactions, spine)
    live = enrolled.where(F.col("transaction_date") >= F.col("account_open_date"))
    seen_events = after_enrolment(events, spine, "event_date")
    key = ["member_id", "observation_date"]

    base = (spine.select("member_id", "account_open_date")
            .join(lifetime_history(live, dates), "member_id", "left")
            .join(parsed_history(members), "member_id", "left"))
    base = member_dates(base, dates).withColumns(lifetime_columns(F.col("_steps"), F.col("_p")))
    obs = F.col("observation_date")
    base = base.select(
        "member_id", "account_open_date", "observation_date", "points_earned_lifetime", "points_clawed_back_lifetime",
        F.col("points_clawed_back_lifetime").alias("points_redeemed_lifetime"),
        F.greatest(F.lit(0).cast("long"), F.col("points_earned_lifetime") - F.col("points_clawed_back_lifetime"))
        .alias("current_point_balance_reconstructed"),
        "last_transaction_date",
        elapsed_days(obs, F.col("last_transaction_date")).alias("recency_days"),
        *[c.alias(n) for n, c in tier_columns(obs).items()],
        elapsed_days(obs, F.col("account_open_date")).alias("tenure_days"))

    wide = (base.join(transaction_windows(enrolled, dates), key, "left")
            .join(transaction_diversity(enrolled, dates), key, "left")
            .join(event_windows(seen_events, dates), key, "left"))
    return wide.na.fill(0, count_columns() + ["spend_slope_30d", "frequency_slope_30d"])


def snapshot_audit(snapshots: DataFrame) -> DataFrame:
    """Rows and active members per observation date."""
    n = F.count(F.lit(1))
    week, month = count_where(F.col("purchase_count_7d") > 0), count_where(F.col("purchase_count_30d") > 0)
    return snapshots.groupBy("observation_date").agg(
        n.alias("n_members"), week.alias("active_7d"), month.alias("active_30d"),
        (week / n * 100.0).alias("pct_active_7d"), (month / n * 100.0).alias("pct_active_30d"))
