"""Snapshots of a table and the files in them.

``files``: table_name, snapshot_id, path, status (1 added, 2 existing, 3 removed), record_count,
bytes. ``snapshots``: table_name, snapshot_id, sequence, committed_at, and more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.functions.ordering import HOT_ROWS, neighbour, running_totals

ADDED, EXISTING, REMOVED = 1, 2, 3


def files_added(df: DataFrame) -> DataFrame:
    """Entries for the files a scan reads: path, record count, bytes."""
    return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.first("_metadata.file_size").alias("bytes")).withColumn("status", F.lit(ADDED))


def live_files(files: DataFrame, snapshot_id: int | None = None,
               keys: Sequence[str] = ("path",)) -> DataFrame:
    """Files in the table at a snapshot: the newest entry of each path decides."""
    if snapshot_id is not None:
        files = files.where(F.col("snapshot_id") <= snapshot_id)
    rest = [c for c in files.columns if c not in keys]
    newest = files.groupBy(*keys).agg(F.max_by(F.struct(*rest), "snapshot_id").alias("_e"))
    return newest.where(F.col("_e.status") != REMOVED).select(*keys, "_e.*")


def snapshot_chain(snapshots: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each snapshot with its parent (0 for the first)."""
    linked = neighbour(snapshots, ["table_name"], ["sequence"], "snapshot_id",
                       "parent_snapshot_id", -1, hot_rows)
    return linked.withColumn("parent_snapshot_id", F.coalesce("parent_snapshot_id", F.lit(0)))


def snapshot_summary(files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per table and snapshot: files and records added, and the totals after it."""
    added, removed = F.col("status") == ADDED, F.col("status") == REMOVED
    sign = F.when(added, 1).when(removed, -1).otherwise(0)
    changes = files.groupBy("table_name", "snapshot_id").agg(
        F.count_if(added).alias("added_files"),
        F.coalesce(F.sum(F.when(added, F.col("record_count"))), F.lit(0)).alias("added_records"),
        F.sum(sign).cast("bigint").alias("_files"),
        F.sum(sign * F.col("record_count")).alias("_records"))
    total = running_totals(
        changes, ["table_name"], ["snapshot_id"],
        {"total_files": F.col("_files"), "total_records": F.col("_records")}, hot_rows)
    return total.drop("_files", "_records")


def summary_map(summary: DataFrame) -> DataFrame:
    """The summary in the form kept with a snapshot: names to text."""
    names = {"added-data-files": "added_files", "total-data-files": "total_files",
             "total-records": "total_records"}
    pairs = [x for name, column in names.items() for x in (F.lit(name), F.col(column).cast("string"))]
    return summary.select("table_name", "snapshot_id", F.create_map(*pairs).alias("summary"))


def column_metrics(df: DataFrame, file: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Per file and column: value and NULL counts, lower and upper bound (as text).

    All columns that have an order, unless some are named. One pass; min, max and counts are combined
    before the shuffle.
    """
    if columns is None:
        columns = [f.name for f in df.schema if f.name != file and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    parts = []
    for i, c in enumerate(columns):
        parts += [F.count(c).alias(f"_n{i}"), F.count_if(F.col(c).isNull()).alias(f"_z{i}"),
                  F.min(c).alias(f"_l{i}"), F.max(c).alias(f"_u{i}")]
    wide = df.groupBy(file).agg(*parts)
    long = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_n{i}").alias("value_count"),
                 F.col(f"_z{i}").alias("null_count"), F.col(f"_l{i}").cast("string").alias("lower"),
                 F.col(f"_u{i}").cast("string").alias("upper"))
        for i, c in enumerate(columns)])
    return wide.select(file, F.inline(long))


def file_metrics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Column metrics per data file of a scan."""
    return column_metrics(
        df.select("*", F.col("_metadata.file_path").alias("path")), "path", columns)


def prune_files(metrics: DataFrame, column: str, low, high, data_type: str) -> DataFrame:
    """Files that may hold a value of ``column`` in [low, high]."""
    return metrics.where(
        (F.col("column_name") == column)
        & (F.col("upper").cast(data_type) >= F.lit(low).cast(data_type))
        & (F.col("lower").cast(data_type) <= F.lit(high).cast(data_type))).select("path").distinct()
