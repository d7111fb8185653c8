"""Tier as of a date, from the JSON history kept with each member.

The order of the list counts, not the order of its dates. Text that is not a
readable list gives the base tier with an unknown direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.functions.exprs import elapsed_days, lookup, ts
from memberlens.schema import TIER_HISTORY, TIER_ORDINALS

DAYS_PER_MONTH = 30.4375

_TYPED = "array<struct<tier:string,date:timestamp>>"


def parsed_history(members: DataFrame) -> DataFrame:
    """(member_id, _tiers, _tiers_ok): the list with typed dates, parsed once per member.

    A member table without the column counts as having empty histories.
    """
    if "tier_history" not in members.columns:
        members = members.withColumn("tier_history", F.lit(None).cast("string"))
    text = F.trim("tier_history")
    blank = F.col("tier_history").isNull() | (text == "null")
    listed = F.when(text.startswith("["), F.from_json(text, TIER_HISTORY))
    typed = F.transform(listed, lambda e: F.struct(
        F.lower(e["tier"]).alias("tier"),
        F.coalesce(F.try_to_timestamp(e["date"], F.lit("yyyy-M-d")),
                   F.try_to_timestamp(e["date"], F.lit("yyyy-M-d H:m:s")),
                   F.try_to_timestamp(e["date"])).alias("date")))
    readable = listed.isNotNull() & ~F.exists(typed, lambda e: e["date"].isNull() | e["tier"].isNull())
    return members.select("member_id",
                          F.when(blank, F.array().cast(_TYPED)).when(readable, typed).alias("_tiers"),
                          (blank | F.coalesce(readable, F.lit(False))).alias("_tiers_ok"))


def _ordinal(tier: Column) -> Column:
    return lookup(tier, TIER_ORDINALS, 0)


def tier_columns(observed: Column) -> dict[str, Column]:
    """Tier columns as of `observed`, from the columns of `parsed_history`."""
    known = F.filter(F.coalesce(F.col("_tiers"), F.array().cast(_TYPED)), lambda e: e["date"] <= observed)
    n = F.size(known)
    last, before = F.try_element_at(known, F.lit(-1)), F.try_element_at(known, F.lit(-2))
    step = _ordinal(last["tier"]) - _ordinal(before["tier"])
    unreadable = ~F.coalesce(F.col("_tiers_ok"), F.lit(True))
    return {
        "current_tier": F.coalesce(last["tier"], F.lit("base")),
        "tier_changes_count": F.greatest(n - 1, F.lit(0)).cast("long"),
        "months_since_last_tier_change":
            F.when(n > 1, elapsed_days(observed, last["date"]) / F.lit(DAYS_PER_MONTH)),
        "tier_trajectory_direction":
            F.when(unreadable, "unknown").when(n < 2, "stable")
             .when(step > 0, "up").when(step < 0, "down").otherwise("stable"),
    }


def tier_as_of(members: DataFrame, date: str) -> DataFrame:
    """(member_id, tier columns) at one observation date."""
    return parsed_history(members).select("member_id", *[c.alias(n) for n, c in tier_columns(ts(date)).items()])
