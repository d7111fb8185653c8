"""All registered queries."""

import importlib

from workload.registry import QUERIES, SQL

for _module in ("q_clean", "q_features", "q_states", "q_scores", "q_outputs"):
    importlib.import_module(f"workload.{_module}")

__all__ = ["QUERIES", "SQL"]
