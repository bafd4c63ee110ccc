"""Queries registered for checking, and the tables they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import csv_queries, detection_queries, file_queries, matching_queries, stored_queries

_MODULES = (matching_queries, detection_queries, stored_queries, file_queries, csv_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
