"""Registered queries by name, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import classify, clusters, stores, tables, texts, vectors

_PLANS = (texts, vectors, tables, classify, clusters, stores)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLE.items()}
