"""Whole runs: the monthly panel, training, and batch scoring of one date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.operators import clean, contact, drift, outputs
from memberlens.operators.features import add_panel_deltas, add_segment_history, add_velocity, behavioural_features, engineer_features, prior_value
from memberlens.operators.segments import SegmentModel, fit_segments, name_segments, profile_clusters, quality
from memberlens.operators.snapshot import build_snapshots
from memberlens.operators.states import classify_states
from memberlens.operators.transitions import TransitionModel, build_pairs, model_columns, train_transition_model, walk_forward
from memberlens.session import configure, cut_lineage
from memberlens.sources.tables import prior_month, write_csv, write_json


def conformed(members: DataFrame, transactions: DataFrame, events: DataFrame, event_order: Sequence[str] = ()) -> tuple[DataFrame, ...]:
    """(spine, transactions, events), typed, de-duplicated and stored once for all later steps.

    Facts of unknown and tagged ids end here: no later step, contact rates included, sees them.
    """
    spine = cut_lineage(clean.build_spine(members))
    return (spine, cut_lineage(clean.only_ids(clean.clean_transactions(transactions), spine)),
            cut_lineage(clean.only_ids(clean.clean_events(events, event_order), spine)))


def feature_panel(members: DataFrame, spine: DataFrame, transactions: DataFrame, events: DataFrame, dates: Sequence[str]) -> DataFrame:
    """Features and states of all members at all dates, stored."""
    return cut_lineage(classify_states(engineer_features(build_snapshots(spine, transactions, events, members, dates))))


def train(panel: DataFrame, fit_date: str, k: int = 5, n_init: int = 10) -> tuple[SegmentModel, TransitionModel]:
    """Segments fitted at `fit_date`, then the transition model on walk-forward pairs.

    Take a fit date no later than the last training month: labels then never use a later month.
    """
    columns = behavioural_features(panel.columns)
    at_fit = panel.where(F.col("observation_date") == F.lit(fit_date).cast("timestamp"))
    segments = fit_segments(at_fit, columns, k, n_init=n_init, fit_date=fit_date)
    profiled = name_segments(profile_clusters(segments.assign(at_fit)))
    names = {r.segment_id: r.segment_name for r in profiled.collect()}  # k rows
    segments.names = [names.get(i, "Unknown") for i in range(k)]
    pairs = walk_forward(cut_lineage(build_pairs(segments.assign(panel), columns), fine=True))
    model = train_transition_model(pairs.where("split = 'train'"), pairs.where("split = 'validation'"), model_columns(columns), k)
    return segments, model


def score(members: DataFrame, transactions: DataFrame, events: DataFrame, date: str, segments: SegmentModel, transition: TransitionModel,
          path: str, event_order: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All outputs of one scoring date, checked against their contracts while they are written below `path`.

    Two earlier months are built in the same pass: changes and segment history need the prior month, and
    that month's acceleration needs the one before it, as in a training panel.
    """
    configure(members.sparkSession)
    spine, transactions, events = conformed(members, transactions, events, event_order)
    panel = segments.assign(feature_panel(members, spine, transactions, events, [prior_month(prior_month(date)), prior_month(date), date]))
    moved = add_panel_deltas(add_velocity(panel)).withColumn("_prev", prior_value(F.col("segment_id")))
    moved = moved.withColumns({"seg_curr": F.col("segment_id"), "y_curr": F.col("state_id"), "month_num": F.month("observation_date")})
    current = cut_lineage(add_segment_history(moved, "_prev").where(F.col("observation_date") == F.lit(date).cast("timestamp")))
    k = len(segments.centroids)
    codes = [f"S{i + 1:02d}" for i in range(k)]

    result = {
        "segment_assignments": outputs.segment_assignments(current),
        "state_assignments": outputs.state_assignments(current),
        "transition_predictions": outputs.transition_predictions(transition.predict(current), k),
        "contact_eligibility": contact.contact_eligibility(members, events, current, date),
    }
    rules = {"segment_assignments": outputs.segment_rules(codes), "state_assignments": outputs.state_rules(),
             "transition_predictions": outputs.prediction_rules(codes)}
    n_members = spine.count()
    for name, df in result.items():
        if name in rules:
            outputs.write_checked(df, f"{path}/{name}", n_members, rules[name])
        else:
            write_csv(df, f"{path}/{name}")
    combined = current.join(clean.cardholder_flags(members), "member_id", "left").na.fill(0, ["is_cardholder"])
    result["segment_profiles"] = outputs.segment_profiles(combined, segments.columns, segments.names)
    write_json(result["segment_profiles"], f"{path}/segment_profiles")
    return result


def check_drift(reference: DataFrame, current: DataFrame, model: SegmentModel, columns: Sequence[str], fail: bool = True) -> DataFrame:
    """The drift verdict of one month of the panel against another, under the frozen segments, stored.

    Covers features, segment and state mix, and the quality of the clusters. With `fail` the run ends with an error if retraining is recommended.
    """
    assigned = [cut_lineage(model.assign(m.drop("segment_id", "segment_name"), keep_point=True).select("segment_id", "state_name", "point")) for m in (reference, current)]
    ch = [quality(a, "segment_id")["calinski_harabasz"] for a in assigned]
    mixes = [drift.total_variation(drift.mix_shift(*assigned, c)) for c in ("segment_id", "state_name")]
    verdict = cut_lineage(drift.drift_verdict(drift.feature_drift(reference, current, columns), *mixes, *ch))
    if fail:
        drift.require_healthy(verdict)
    return verdict
