"""Neighbours and running totals in ordered groups of any size, and places in sorted arrays.

A plain window puts each group into one task. Groups beyond ``HOT_ROWS`` rows are cut
into slices that follow the order; each slice is a window of its own, and one value per
slice carries over to the next. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelake.session import freeze, sized

HOT_ROWS = 4_000_000
SLICE = "_slice"


def _split(df: DataFrame, group: Sequence[str], order: Sequence[str],
           hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """``df`` without its large groups, and the sliced large groups (None if there are none)."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    if counts.isEmpty():
        return df, None
    counts = freeze(counts)
    total = counts.agg(F.sum("_rows")).first()[0]
    hot = sized(counts.select(*group))
    large = df.join(hot, list(group), "left_semi")
    return (df.join(hot, list(group), "left_anti"),
            _slices(large, group, order, total // hot_rows + 1))


def _slices(df: DataFrame, group: Sequence[str], order: Sequence[str], least: int) -> DataFrame:
    """Rows with a slice number that never falls along ``order`` within a group.

    The number is the range partition, so it is fixed before anything is computed from it.
    """
    parts = max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *group, *order)
    return freeze(ranged.withColumn(SLICE, F.spark_partition_id()))


def neighbour(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str,
              step: int = 1, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``value`` (not NULL) of the next row of the group, or of the previous one for ``step=-1``."""
    move, edge = (F.lead, F.min_by) if step > 0 else (F.lag, F.max_by)
    group, order = list(group), list(order)
    columns = [*df.columns, out]
    small, sliced = _split(df, group, order, hot_rows)
    result = small.withColumn(
        out, move(value).over(W.partitionBy(*group).orderBy(*order))).select(*columns)
    if sliced is None:
        return result
    inner = sliced.withColumn(out, move(value).over(W.partitionBy(*group, SLICE).orderBy(*order)))
    edges = sliced.groupBy(*group, SLICE).agg(edge(value, F.struct(*order)).alias("_edge"))
    carry = edges.select(*group, SLICE, move("_edge").over(
        W.partitionBy(*group).orderBy(SLICE)).alias("_carry"))
    joined = inner.join(sized(carry), [*group, SLICE])
    return result.unionByName(
        joined.withColumn(out, F.coalesce(out, "_carry")).drop(SLICE, "_carry"))


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str],
                   measures: dict[str, Column], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per measure, its sum over the group's rows up to and including this one.

    ``order`` must be unique within a group.
    """
    group, order, columns = list(group), list(order), [*df.columns, *measures]
    small, sliced = _split(df.withColumns(measures), group, order, hot_rows)

    def so_far(rows: DataFrame, *keys: str) -> DataFrame:
        window = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return rows.withColumns({m: F.sum(m).over(window) for m in measures})

    result = so_far(small, *group).select(*columns)
    if sliced is None:
        return result
    totals = sliced.groupBy(*group, SLICE).agg(*[F.sum(m).alias(m) for m in measures])
    before = W.partitionBy(*group).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*group, SLICE, *[
        F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_carry_{m}") for m in measures])
    joined = so_far(sliced, *group, SLICE).join(sized(carry), [*group, SLICE])
    return result.unionByName(
        joined.withColumns({m: F.col(m) + F.col(f"_carry_{m}") for m in measures}).select(*columns))


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], measure: Column,
                  out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    return running_totals(df, group, order, {out: measure}, hot_rows)


def bisect(array: Column, value: Column, longest: int) -> Column:
    """How many elements of a sorted array of at most ``longest`` are at most ``value`` (0 if NULL).

    One expression that halves what is left: a row costs the logarithm of the array's length.
    """
    halves = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, longest.bit_length())))))
    return F.aggregate(halves, F.lit(0), lambda n, half: F.when(
        F.get(array, n + half - 1) <= value, n + half).otherwise(n))
