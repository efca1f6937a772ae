"""Small Parquet logs: tables, snapshots, files, batches."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def parts(spark: SparkSession, path: str) -> list[int]:
    """Numbers of a log's parts (``<name>=<number>``), from one listing and without a job.

    A part may be unfinished; ``finished`` tells.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    named = (re.search(r"path=[^;]*/[a-z]+=(\d+);", entry.toString()) for entry in fs.listStatus(target))
    return sorted(int(n[1]) for n in named if n)


def finished(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_SUCCESS")


def read_parts(spark: SparkSession, path: str, name: str, numbers: Sequence[int], schema: str) -> DataFrame:
    """Rows of the given parts; their number is the column ``name``."""
    if not numbers:
        return spark.createDataFrame([], schema)
    columns = T.StructType.fromDDL(schema).names
    return (spark.read.schema(schema).option("basePath", path)
            .parquet(*(f"{path}/{name}={n}" for n in numbers)).select(*columns))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a directory that nothing refers to any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as file listings spell it, with its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log; none if nothing was written yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    columns = T.StructType.fromDDL(schema).names
    return spark.read.schema(schema).parquet(path).select(*columns)


def write_log(rows: DataFrame, path: str, *partition: str) -> None:
    """Write one part of a log. Writing it again replaces it, so a repeat after a failure is harmless."""
    rows.write.mode("overwrite").partitionBy(*partition).parquet(path)
