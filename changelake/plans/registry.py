"""Registered queries: a Spark callable each, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with the SQL to check it against."""
    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            CHECKS[key] = sql
        return function
    return add
