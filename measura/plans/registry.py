"""All registered core queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("notes", "joins", "sequences", "text", "catalogue", "more", "streams", "grouped", "periods", "rules")


def collect() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}
    for name in MODULES:
        m = import_module(f"measura.plans.{name}")
        queries |= m.QUERIES
        oracles |= m.ORACLES
    return queries, oracles
