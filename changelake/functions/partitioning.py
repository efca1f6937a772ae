"""Partition transforms: a partition column computed from a source column."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PartitionField(NamedTuple):
    source: str
    transform: str  # year, month, day, bucket, truncate
    name: str
    width: int | None = None  # bucket count or truncation width


def transform(df: DataFrame, field: PartitionField) -> Column:
    column = F.col(field.source)
    if field.transform == "year":
        return F.year(column)
    if field.transform == "month":
        return F.to_date(F.date_trunc("month", column))
    if field.transform == "day":
        return F.to_date(column)
    if field.transform == "bucket":
        return bucket([field.source], field.width)
    if field.transform == "truncate":
        if isinstance(df.schema[field.source].dataType, T.StringType):
            return F.substring(column, 1, field.width)
        return column - F.pmod(column, F.lit(field.width))
    raise ValueError(f"unknown transform {field.transform!r}")


def bucket(columns: Iterable[str], count: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")


def linear_bucket(columns: Iterable[str], start: int, count: int) -> Column:
    """Linear hashing: of ``start * 2^n`` buckets, those that were split have a twin ``start * 2^n`` on.

    With one bucket more, the rows of one bucket move; all others stay.
    """
    whole = start << ((count // start).bit_length() - 1)
    value = F.xxhash64(*columns)
    low = F.pmod(value, F.lit(whole))
    return F.when(low < count - whole, F.pmod(value, F.lit(2 * whole))).otherwise(low).cast("int")


def split_from(bucket: int, start: int, count: int) -> int:
    """The bucket that held the rows of ``bucket`` when there were ``count`` buckets."""
    while bucket >= count:
        bucket -= start << ((bucket // start).bit_length() - 1)
    return bucket


def partition_by(df: DataFrame, spec: Iterable[PartitionField]) -> DataFrame:
    """``df`` with one column per partition field, ready for ``write.partitionBy``."""
    return df.withColumns({field.name: transform(df, field) for field in spec})


def write_partitioned(df: DataFrame, spec: Iterable[PartitionField], path: str,
                      mode: str = "append") -> None:
    """Write a directory per partition value.

    Rows are gathered by value so that files are few; adaptive execution splits a value that
    holds much of the data over several tasks.
    """
    spec = list(spec)
    names = [field.name for field in spec]
    partition_by(df, spec).hint("rebalance", *names).write.mode(mode).partitionBy(*names).parquet(path)
