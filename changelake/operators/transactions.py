"""Transactions: rows become visible at their commit, aborted ones never.

Input is a feed with ``lsn, seq, xid, sub_xid, kind`` and any further columns. Marker rows
carry the commit position as their ``lsn``. Markers are reduced to one row per transaction
before the join; rows meet them by broadcast if the markers are counted to be few, else in a
shuffle whose skewed transactions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.session import fits, freeze, sized
from changelake.sources.envelope import ABORTS, COMMITS, rows_only


def markers(changes: DataFrame) -> DataFrame:
    """One row per finished transaction: xid, commit_lsn (NULL if aborted), aborted."""
    whole = F.col("kind").isin(*ABORTS) & (F.col("sub_xid").isNull() | (F.col("sub_xid") == F.col("xid")))
    commit = F.col("kind").isin(*COMMITS)
    return (changes.where(commit | whole).groupBy("xid")
            .agg(F.min(F.when(commit, F.col("lsn"))).alias("commit_lsn"),
                 F.max(whole).alias("aborted"))
            .withColumn("commit_lsn", F.when(~F.col("aborted"), F.col("commit_lsn"))))


def aborted_parts(changes: DataFrame) -> DataFrame:
    """(xid, sub_xid) of sub-transactions that were rolled back."""
    return changes.where(
        F.col("kind").isin(*ABORTS) & (F.col("sub_xid") != F.col("xid"))
    ).select("xid", "sub_xid").distinct()


def outside(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows that are not in the given sub-transactions.

    Unless the parts are few, only rows that are in some sub-transaction shuffle to meet them.
    """
    if fits(parts):
        return rows.join(F.broadcast(parts), ["xid", "sub_xid"], "left_anti")
    inside = F.coalesce(F.col("sub_xid") != F.col("xid"), F.lit(False))
    return rows.where(~inside).unionByName(
        rows.where(inside).join(parts.hint("merge"), ["xid", "sub_xid"], "left_anti"))


def committed(changes: DataFrame, rows: DataFrame | None = None, ends: DataFrame | None = None,
              parts: DataFrame | None = None) -> DataFrame:
    """Rows of committed transactions with their ``commit_lsn``.

    ``rows`` defaults to the row messages of ``changes``; a streaming batch adds earlier ones.
    ``ends`` are the sized markers and ``parts`` the aborted parts, where they are at hand.
    """
    rows = rows_only(changes) if rows is None else rows
    ends = sized(markers(changes)) if ends is None else ends
    rows = outside(rows, aborted_parts(changes) if parts is None else parts)
    return rows.join(ends.where("NOT aborted").select("xid", "commit_lsn"), "xid")


def rolled_back(changes: DataFrame) -> DataFrame:
    """Rows that an abort of their transaction or sub-transaction discards."""
    whole = markers(changes).where("aborted").select("xid", F.lit(True).alias("_whole"))
    parts = aborted_parts(changes).withColumn("_part", F.lit(True))
    return (rows_only(changes).join(sized(parts), ["xid", "sub_xid"], "left")
            .join(sized(whole), "xid", "left")
            .where("_whole OR _part").drop("_whole", "_part"))


def pending(changes: DataFrame, ends: DataFrame | None = None,
            parts: DataFrame | None = None) -> DataFrame:
    """Rows whose transaction has not ended, without parts already rolled back."""
    ends = sized(markers(changes)) if ends is None else ends
    rows = outside(rows_only(changes), aborted_parts(changes) if parts is None else parts)
    return rows.join(ends.select("xid"), "xid", "left_anti")


def deduplicate(changes: DataFrame) -> DataFrame:
    """Each message once, however often it was delivered."""
    return changes.dropDuplicates(["lsn", "seq"])


def distinct_messages(changes: DataFrame) -> DataFrame:
    """The same for changes at hand (cached or on disk): their positions are counted first, and only
    messages that came more than once are grouped as whole rows. ``changes`` itself if none did."""
    again = freeze(changes.groupBy("lsn", "seq").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
                   .select(F.col("lsn").alias("_lsn"), F.col("seq").alias("_seq")))
    if again.isEmpty():
        return changes
    if not fits(again):
        return deduplicate(changes)
    same, again = F.expr("lsn <=> _lsn AND seq <=> _seq"), F.broadcast(again)
    return changes.join(again, same, "left_anti").unionByName(
        deduplicate(changes.join(again, same, "left_semi")))


def with_base(base: DataFrame, log: DataFrame) -> DataFrame:
    """A copy of the table from before the feed, ordered before every change."""
    start = base.withColumns({
        "kind": F.lit("insert"), "lsn": F.lit(0).cast("bigint"), "seq": F.lit(0),
        "commit_lsn": F.lit(0).cast("bigint")})
    return log.unionByName(start, allowMissingColumns=True)
