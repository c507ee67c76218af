"""Queries of this subpackage by name; each module brings its own and, where SQL can say it, a SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["quality_crf", "substring_dedup", "packing", "ngram_join", "language_id", "secret_scan", "decontaminate", "quality_rules", "toxicity", "pii", "bpe", "hard_negatives", "alignment"]


def _loaded():
    return [importlib.import_module(f"opslens.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return {name: fn for module in _loaded() for name, fn in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    """SQL twins by name."""
    return {name: sql for module in _loaded() for name, sql in getattr(module, "ORACLES", {}).items()}
