"""Checked queries over the test tables."""

import importlib

MODULES = ["stats_checks", "task_checks", "flow_checks", "metric_checks", "alert_checks", "graph_checks", "log_checks", "document_checks", "apply_checks", "stream_checks"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"checks.{name}")
