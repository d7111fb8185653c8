"""Stages the queries start from.

The conformed facts and the monthly feature panel are stage outputs: a real run
stores them once and every later job reads them. Here they are written to the
checkpoint folder on first use and read back by each query that builds on them.
The queries about the snapshot and feature operators themselves do not use the
stored panel but build it anew from the conformed facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberlens.functions.exprs import lookup
from memberlens.operators.clean import build_spine, clean_events, clean_transactions, only_ids
from memberlens.operators.features import engineer_features
from memberlens.operators.snapshot import build_snapshots
from memberlens.operators.states import classify_states
from memberlens.session import cut_lineage
from workload.adapter import MONTHS, OBSERVED, SEGMENT_NAMES, SEGMENT_RULE, raw_events, raw_members, raw_transactions, scored_rows

_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, str(sf_dir), name)
    if key not in _stored:
        _stored[key] = cut_lineage(build(), fine=True)
    return _stored[key]


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, spine, transactions, events), conformed and stored. Facts are those of spine members."""
    members = stored(spark, sf_dir, "members", lambda: raw_members(spark, sf_dir))
    spine = stored(spark, sf_dir, "spine", lambda: build_spine(members))
    transactions = stored(spark, sf_dir, "transactions", lambda: only_ids(clean_transactions(raw_transactions(spark, sf_dir)), spine))
    events = stored(spark, sf_dir, "events", lambda: only_ids(clean_events(raw_events(spark, sf_dir), ["event_no"]), spine))
    return members, spine, transactions, events


def fresh_snapshots(spark: SparkSession, sf_dir: str, dates=MONTHS) -> DataFrame:
    members, spine, transactions, events = facts(spark, sf_dir)
    return build_snapshots(spine, transactions, events, members, dates)


def fresh_features(spark: SparkSession, sf_dir: str, dates=MONTHS) -> DataFrame:
    return engineer_features(fresh_snapshots(spark, sf_dir, dates))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "snapshots", lambda: fresh_snapshots(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly features, states and rule-based segments."""
    def build() -> DataFrame:
        # from the facts, not from stored snapshots: the rows of a member lie together already
        out = classify_states(fresh_features(spark, sf_dir))
        return out.withColumn("segment_id", F.expr(SEGMENT_RULE).cast("int")).withColumn(
            "segment_name", lookup(F.col("segment_id"), dict(enumerate(SEGMENT_NAMES))))

    return stored(spark, sf_dir, "panel", build)


def observed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at the single scoring date."""
    def build() -> DataFrame:
        out = classify_states(fresh_features(spark, sf_dir, (OBSERVED,)))
        return out.withColumn("segment_id", F.expr(SEGMENT_RULE).cast("int")).withColumn(
            "segment_name", lookup(F.col("segment_id"), dict(enumerate(SEGMENT_NAMES))))

    return stored(spark, sf_dir, "observed", build)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows, the stored output of a prediction run."""
    return stored(spark, sf_dir, "scored", lambda: scored_rows(spark, sf_dir))


def month(df: DataFrame, date: str) -> DataFrame:
    return df.where(F.col("observation_date") == F.lit(date).cast("timestamp"))
