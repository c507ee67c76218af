"""Scales, thresholds, rules and word lists that results depend on."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Seven-level scale of scheduled tasks, higher wins.
PRIORITY7 = {"IDLE": 0, "BACKGROUND": 10, "LOW": 20, "NORMAL": 50, "HIGH": 80, "CRITICAL": 90, "REALTIME": 100}

# Five-level scale of distributed tasks, lower wins.
PRIORITY5 = {"CRITICAL": 0, "HIGH": 1, "NORMAL": 2, "LOW": 3, "BACKGROUND": 4}

# First feedback level per seven-level priority and time slice per level.
FEEDBACK_LEVEL = {100: 0, 90: 0, 80: 1, 50: 2, 20: 3, 10: 3, 0: 3}
TIME_SLICES_MS = [10, 20, 40, 80]

# Latency limits in milliseconds per priority: scheduling, execution.
LATENCY_LIMITS_MS = {100: (10, 100), 90: (50, 500), 80: (100, 1000), 50: (500, 5000)}

# Default histogram bounds (seconds) and those of reasoning depth.
HISTOGRAM_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
REASONING_DEPTH_BOUNDS = [1, 2, 3, 5, 10, 15, 20]

# Health limits in percent: degraded above the first, unhealthy above the second.
HEALTH_LIMITS = {"memory": (80.0, 90.0), "cpu": (70.0, 90.0)}
HEALTH_RANK = {"healthy": 0, "degraded": 1, "unhealthy": 2}

# Kept history per metric and per latency or tick series.
METRIC_HISTORY = 10_000
LATENCY_HISTORY = 1_000

# Allowed status moves of a task.
LIFECYCLE = [
    ("pending", "ready"),
    ("pending", "blocked"),
    ("blocked", "pending"),
    ("pending", "cancelled"),
    ("pending", "deadline_missed"),
    ("ready", "running"),
    ("ready", "blocked"),
    ("running", "completed"),
    ("running", "failed"),
]

# Key words that make a configuration value sensitive.
SENSITIVE_WORDS = ["password", "secret", "key", "token", "credential"]

# Shape of an accepted URL.
URL_PATTERN = r"^https?://[\w\-._~:/?#\[\]@!$&'()*+,;=]+$"

# Threshold rules: name, metric, label matcher, comparison, threshold, hold seconds, severity, component.
ALERT_RULES = [
    ("HighPerceptionLatency", "perception_latency_ms", {}, ">", 100.0, 60, "critical", "perception"),
    ("HighSystem1Latency", "reasoning_latency_ms", {"system": "1"}, ">", 50.0, 60, "warning", "reasoning"),
    ("HighSystem2Latency", "reasoning_latency_ms", {"system": "2"}, ">", 500.0, 60, "warning", "reasoning"),
    ("HighMemoryLatency", "memory_access_latency_ms", {"type": "working"}, ">", 10.0, 60, "critical", "memory"),
    ("HighCognitiveLoad", "cognitive_load_percent", {}, ">", 80.0, 300, "warning", "cognitive"),
    ("TaskQueueBacklog", "queue_size", {}, ">", 1000.0, 300, "warning", "distributed"),
    ("InsufficientWorkers", "active_workers", {}, "<", 2.0, 120, "critical", "distributed"),
    ("HighTaskFailureRate", "rate(tasks_failed_total[5m])", {}, ">", 0.1, 300, "warning", "execution"),
    ("LowConsciousnessLevel", "consciousness_level", {}, "<", 0.3, 600, "info", "cognitive"),
]
RULE_SCHEMA = (
    "rule string, metric string, matcher map<string,string>, cmp string, threshold double, "
    "hold_seconds bigint, severity string, component string"
)


def lookup(column: Column | str, table: dict, default=None) -> Column:
    """Constant lookup as an expression; no join for tables of a handful of rows."""
    col = F.col(column) if isinstance(column, str) else column
    expr = F.lit(default)
    for key, value in table.items():
        expr = F.when(col == F.lit(key), F.lit(value)).otherwise(expr)
    return expr


def priority7_name(column: Column | str) -> Column:
    return lookup(column, {v: k for k, v in PRIORITY7.items()})


def priority7_value(column: Column | str) -> Column:
    return lookup(column, PRIORITY7)


def priority5_name(column: Column | str) -> Column:
    return lookup(column, {v: k for k, v in PRIORITY5.items()})


def priority5_value(column: Column | str) -> Column:
    return lookup(column, PRIORITY5)
