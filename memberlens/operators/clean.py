"""Conformance of the raw tables and referential integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberlens.functions.exprs import clip, indicator, parse_timestamp
from memberlens.schema import EVENT_KEY, GHOST_PREFIX, SESSION_CAP_SECONDS


def strict_timestamp(df: DataFrame, column: str) -> Column:
    """Typed timestamp of a column; text in none of the accepted layouts fails the job.

    The check is part of the plan, so it costs no extra pass.
    """
    source = F.col(column)
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return source.cast("timestamp")
    parsed = parse_timestamp(source)
    message = F.concat(F.lit(f"column {column}: no accepted date layout for '"), source, F.lit("'"))
    return F.when(source.isNull(), F.lit(None).cast("timestamp")).otherwise(
        F.coalesce(parsed, F.raise_error(message).cast("timestamp")))


def parse_timestamps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: strict_timestamp(df, c) for c in columns})


def unparsed_dates(df: DataFrame, column: str) -> DataFrame:
    """Distinct values the strict parser would reject, with their row counts."""
    bad = F.col(column).isNotNull() & parse_timestamp(F.col(column)).isNull()
    return df.where(bad).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def normalise_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trim and lower-case category columns that are present; nulls stay null."""
    return df.withColumns({c: F.lower(F.trim(F.col(c))) for c in columns if c in df.columns})


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in a declared total order.

    An aggregate rather than a row-number window, so duplicates collapse before
    the shuffle and a key with a huge number of copies never sits in one task.
    """
    carried = [c for c in df.columns if c not in key]
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in carried if c not in order])
    picked = df.groupBy(*key).agg(F.min(rank).alias("_first"))
    return picked.select(*[F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in df.columns])


def dedup_events(events: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    return keep_first(events, EVENT_KEY, order)


def cap_sessions(events: DataFrame, cap: float = SESSION_CAP_SECONDS) -> DataFrame:
    if "session_duration_sec" not in events.columns:
        return events
    return events.withColumn("session_duration_sec", clip(F.col("session_duration_sec"), high=cap))


def clip_to_bounds(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Apply (low, high) bounds to the columns that exist."""
    return df.withColumns({
        c: clip(F.col(c).cast("double"), low, high) for c, (low, high) in bounds.items() if c in df.columns})


def _ids(df: DataFrame) -> DataFrame:
    return df.select("member_id").where(F.col("member_id").isNotNull()).distinct()


def tagged_ghosts(members: DataFrame) -> DataFrame:
    return members.where(F.col("member_id").startswith(GHOST_PREFIX)).select("member_id").distinct()


def orphan_ids(members: DataFrame, *facts: DataFrame) -> DataFrame:
    """Ids with activity but no member row."""
    seen = _ids(facts[0])
    for fact in facts[1:]:
        seen = seen.union(_ids(fact))
    return seen.distinct().join(members.select("member_id"), "member_id", "left_anti")


def ghost_ids(members: DataFrame, *facts: DataFrame) -> DataFrame:
    """Tagged ids and orphans; both are excluded downstream."""
    tagged = tagged_ghosts(members).withColumn("kind", F.lit("tagged"))
    if not facts:
        return tagged
    return tagged.union(orphan_ids(members, *facts).withColumn("kind", F.lit("orphan")))


def orphan_breakdown(members: DataFrame, transactions: DataFrame, events: DataFrame) -> DataFrame:
    """Where orphans occur: transactions only, events only, both."""
    both = (_ids(transactions).withColumn("_t", F.lit(1))
            .join(_ids(events).withColumn("_e", F.lit(1)), "member_id", "full")
            .join(members.select("member_id"), "member_id", "left_anti"))
    place = (F.when(F.col("_e").isNull(), "transactions_only").when(F.col("_t").isNull(), "events_only")
             .otherwise("both"))
    return both.groupBy(place.alias("found_in")).agg(F.count(F.lit(1)).alias("n_ids"))


def exclude_ids(facts: DataFrame, ids: DataFrame) -> DataFrame:
    return facts.join(ids.select("member_id"), "member_id", "left_anti")


def only_ids(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Activity of the given ids, e.g. the guest cohort."""
    return facts.join(ids.select("member_id"), "member_id", "left_semi")


def build_spine(members: DataFrame, ghosts: DataFrame | None = None) -> DataFrame:
    """(member_id, account_open_date) of every real member.

    Orphans have no member row, so only tagged ids can occur here; passing a
    ghost table excludes those ids as well.
    """
    real = members.where(~F.col("member_id").startswith(GHOST_PREFIX))
    if ghosts is not None:
        real = exclude_ids(real, ghosts)
    return real.select("member_id", F.col("account_open_date").cast("timestamp").alias("account_open_date"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def assert_unique(df: DataFrame, key: Sequence[str]) -> None:
    examples = duplicate_keys(df, key).take(5)
    if examples:
        raise AssertionError(f"duplicate key {tuple(key)}: {[r.asDict() for r in examples]}")


def shared_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("member_id").intersect(right.select("member_id"))


def assert_disjoint(left: DataFrame, right: DataFrame) -> None:
    examples = shared_ids(left, right).take(5)
    if examples:
        raise AssertionError(f"ids on both sides: {[r.member_id for r in examples]}")


def inactive_members(spine: DataFrame, transactions: DataFrame, events: DataFrame) -> DataFrame:
    """Members without any activity. They stay on the spine."""
    active = _ids(transactions).union(_ids(events)).distinct()
    return spine.join(active, "member_id", "left_anti")


def activity_summary(spine: DataFrame, transactions: DataFrame, events: DataFrame) -> DataFrame:
    flags = (spine.select("member_id")
             .join(_ids(transactions).withColumn("_t", F.lit(1)), "member_id", "left")
             .join(_ids(events).withColumn("_e", F.lit(1)), "member_id", "left"))
    has_t, has_e = F.col("_t").isNotNull(), F.col("_e").isNotNull()
    return flags.agg(
        F.count(F.lit(1)).alias("total_members"),
        F.count(F.when(has_t, 1)).alias("members_with_transactions"),
        F.count(F.when(has_e, 1)).alias("members_with_engagement"),
        F.count(F.when(has_t | has_e, 1)).alias("members_with_any_activity"),
        F.count(F.when(~has_t & ~has_e, 1)).alias("zero_activity_members"))


def cardholder_flags(members: DataFrame) -> DataFrame:
    real = members.where(~F.col("member_id").startswith(GHOST_PREFIX))
    return real.select("member_id", indicator(F.col("credit_line").isNotNull()).alias("is_cardholder"))


def clean_transactions(transactions: DataFrame) -> DataFrame:
    categories = ["channel", "transaction_type", "merchant_category", "merchant_subcategory", "merchant_brand"]
    return parse_timestamps(normalise_text(transactions, categories), ["transaction_date"])


def clean_events(events: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Normalise, parse, de-duplicate and cap. Parsing comes first: the key holds the instant, not its text."""
    typed = parse_timestamps(normalise_text(events, ["event_type", "event_channel"]), ["event_date"])
    return cap_sessions(dedup_events(typed, order))
