"""Headline timings: prints one JSON line.

BENCH_SF_DIR  tables to read (default /root/testdata/sf0.1)
BENCH_CPUS    local cores   (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

# Stages are timed on their own first, so that no query pays for what later ones read.
STAGES = ("facts", "panel", "observed_panel", "scored")
HEADLINE = (
    "single_date_snapshot",
    "multi_date_panel",
    "event_dedup",
    "weekly_slopes",
    "snapshot_audit",
    "state_cascade",
    "velocity_features",
    "month_over_month_deltas",
    "transition_pairs",
    "state_transition_matrix",
    "business_sanity",
    "collinear_pairs",
    "equal_width_psi",
    "feature_drift_report",
    "cluster_profiles",
    "business_table",
    "contact_eligibility",
    "value_at_risk",
    "expected_value_sweep",
    "operating_points",
    "threshold_f1_curves",
    "expected_calibration_error",
    "cohort_members",
    "kmeans_segments",
)


def whole_runs(spark, sf_dir: str) -> dict[str, float]:
    """Training on the stored panel and one scoring run from raw tables, end to end."""
    from memberlens.plans import scoring
    from memberlens.session import stage_path
    from workload import stages
    from workload.adapter import MONTHS, OBSERVED, raw_events, raw_members, raw_transactions

    started = time.time()
    panel = stages.panel(spark, sf_dir).drop("segment_id", "segment_name")
    segments, model = scoring.train(panel, MONTHS[3])
    trained = time.time()
    scoring.score(raw_members(spark, sf_dir), raw_transactions(spark, sf_dir), raw_events(spark, sf_dir), OBSERVED, segments, model,
                  stage_path(spark), ["event_no"])
    return {"train_end_to_end": round(trained - started, 3), "score_end_to_end": round(time.time() - trained, 3)}


def main() -> None:
    from memberlens.session import local_session
    from workload import stages
    from workload.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor before the clock
    times = {}
    for name in STAGES:
        started = time.time()
        getattr(stages, name)(spark, sf_dir)
        times[f"stage_{name}"] = round(time.time() - started, 3)
    for name in HEADLINE:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    times |= whole_runs(spark, sf_dir)
    print(json.dumps({"metric": "member analytics headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
