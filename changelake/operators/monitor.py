"""Monitoring as aggregates over log tables: messages, queries, compactions, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from changelake.session import sized
from changelake.sources.envelope import ROW_KINDS

# Upper bounds in seconds of the duration histogram.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, float("inf"))

# Labels of the message counter; any other kind is "unknown".
LABELS = ("relation", "begin", "commit", "insert", "update", "delete", "message", "stream_start",
          "stream_stop", "stream_commit", "stream_abort", "truncate", "type", "origin")

RANK = {"healthy": 0, "degraded": 1, "unhealthy": 2}


def label(kind: str = "kind") -> Column:
    return F.when(F.col(kind).isin(*LABELS), F.col(kind)).otherwise("unknown")


def kind_counts(changes: DataFrame) -> DataFrame:
    """Messages by kind."""
    return changes.groupBy(label().alias("kind")).agg(F.count(F.lit(1)).alias("messages"))


def observe_kinds(changes: DataFrame, observation: Observation) -> DataFrame:
    """The same counts taken while a batch flows by, at no extra pass."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in LABELS]
    return changes.observe(observation, *counts, F.max("lsn").alias("last_lsn"))


def last_lsn(changes: DataFrame) -> DataFrame:
    return changes.agg(F.max("lsn").alias("last_lsn"))


def lag_by_table(changes: DataFrame, applied: DataFrame, table: str = "relation_id") -> DataFrame:
    """Bytes between the newest change of a table and the position its snapshots reached.

    ``applied``: the table and ``max_lsn``, any number of rows per table.
    """
    seen = changes.where(F.col("kind").isin(*ROW_KINDS)).groupBy(table).agg(
        F.max("lsn").alias("feed_lsn"))
    done = applied.groupBy(table).agg(F.max("max_lsn").alias("applied_lsn"))
    reached = F.coalesce("applied_lsn", F.lit(0).cast("bigint"))
    return seen.join(done, table, "left").select(
        table, "feed_lsn", reached.alias("applied_lsn"),
        F.greatest(F.col("feed_lsn") - reached, F.lit(0)).alias("lag_bytes"))


def duration_histogram(log: DataFrame, seconds: str, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """Cumulative histogram with the sum and count of all durations, in one pass."""
    counts = [F.count_if(F.col(seconds) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    row = log.agg(*counts, F.coalesce(F.sum(seconds), F.lit(0.0)).alias("sum_seconds"),
                  F.count(seconds).alias("queries"))
    lines = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("at_most"))
                      for i, b in enumerate(bounds)])
    return row.select(F.inline(lines), "sum_seconds", "queries")


def query_counts(log: DataFrame, by: str) -> DataFrame:
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("queries"))


def slow_queries(log: DataFrame, seconds: str, threshold_ms: int) -> DataFrame:
    """Queries at or above the threshold; a threshold of 0 turns the list off."""
    if threshold_ms <= 0:
        return log.where(F.lit(False))
    return log.where(F.col(seconds) * 1000 >= threshold_ms)


def compaction_totals(runs: DataFrame) -> DataFrame:
    """Counters over the compaction log."""
    return runs.agg(
        F.count(F.lit(1)).alias("runs"), F.sum("files_processed").alias("files_processed"),
        F.sum("files_compacted").alias("files_compacted"), F.sum("bytes_saved").alias("bytes_saved"),
        F.sum("seconds").alias("seconds"))


def latest_status(checks: DataFrame) -> DataFrame:
    """Newest stored result of each component."""
    newest = F.max_by(F.struct("status", "message", "checked_at"), F.struct("checked_at", "check_id"))
    return checks.groupBy("component").agg(newest.alias("_r")).select("component", "_r.*")


def status_rollup(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Worst status: unhealthy before degraded before healthy."""
    rank = F.lit(None).cast("int")
    for name, value in RANK.items():
        rank = F.when(F.col("status") == name, value).otherwise(rank)
    worst = F.coalesce(F.max_by("status", rank), F.lit("healthy"))
    return checks.groupBy(*by).agg(worst.alias("status"), F.count(F.lit(1)).alias("checks"))


def storage_status(tables: DataFrame, files: DataFrame) -> DataFrame:
    """Files and bytes below each table directory; a table without files is degraded."""
    # Each file names its table by its own path, so this is an equi join.
    owner = F.regexp_extract("path", "^(.*?)/(?:data|log|metadata)/", 1)
    sizes = files.groupBy(owner.alias("table_dir")).agg(
        F.count_if(F.col("path").endswith(".parquet")).alias("files"), F.sum("length").alias("bytes"))
    found = sized(tables).join(sizes, "table_dir", "left")
    return found.select(
        F.col("table_dir").alias("component"),
        F.when(F.coalesce("files", F.lit(0)) > 0, "healthy").otherwise("degraded").alias("status"),
        F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def error_counts(errors: DataFrame) -> DataFrame:
    """Quarantined rows by reason."""
    return errors.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("errors"))
