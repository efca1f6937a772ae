"""Spark SQL over mirrored tables, and the checks that go with it."""

from __future__ import annotations

import datetime
import time
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from changelake.functions.types import source_type
from changelake.session import fits, freeze

QUERY_LOG = "statement STRING, status STRING, started_at TIMESTAMP, seconds DOUBLE"


def query(spark: SparkSession, text: str, args: dict[str, Any] | list | None = None) -> DataFrame:
    """SQL text with named (``:name``) or positional (``?``) parameters, which keep their types."""
    return spark.sql(text, args=args) if args else spark.sql(text)


def run_logged(spark: SparkSession, text: str, log: str,
               args: dict[str, Any] | list | None = None) -> DataFrame:
    """Run SQL text to its end and append a row on it to the query log, failed queries included.

    The result stays on the cluster, in the shared folder; the duration is that of the whole query.
    """
    started, clock, status = datetime.datetime.now(datetime.timezone.utc), time.time(), "error"
    try:
        result = freeze(query(spark, text, args))
        status = "ok"
        return result
    finally:
        row = (text, status, started, time.time() - clock)
        spark.createDataFrame([row], QUERY_LOG).coalesce(1).write.mode("append").parquet(log)


def register(tables: dict[str, DataFrame], keep_small: bool = False) -> None:
    """Make tables resolvable by name.

    ``keep_small`` holds tables that are counted to be small in memory, in one partition: short
    queries on them then need neither a listing nor a shuffle.
    """
    for name, df in tables.items():
        if keep_small and fits(df):
            df = df.coalesce(1).cache()
        df.createOrReplaceTempView(name)


def describe(df: DataFrame) -> DataFrame:
    """Result columns with their Spark and source type names."""
    return df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), source_type(f.dataType))
         for i, f in enumerate(df.schema, 1)],
        "ordinal INT, name STRING, spark_type STRING, source_type STRING")


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Child rows whose (child, parent) key columns match no parent row. A NULL refers to none."""
    child = child.where(" AND ".join(f"`{c}` IS NOT NULL" for c, _ in keys))
    parents = parent.select(*[p for _, p in keys])
    match = None
    for c, p in keys:
        same = child[c] == parents[p]
        match = same if match is None else match & same
    return child.join(parents, match, "left_anti")
