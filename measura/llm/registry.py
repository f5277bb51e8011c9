"""All registered queries of this subpackage."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_tokens", "q_repair", "q_language", "q_runs", "q_names", "q_abuse")


def collect() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}
    for name in MODULES:
        try:
            m = import_module(f"measura.llm.{name}")
        except ImportError as e:  # a library that this module needs isn't there
            warnings.warn(f"queries of {name} are left out: {e}", stacklevel=2)
            continue
        queries |= m.QUERIES
        oracles |= m.ORACLES
    return queries, oracles
