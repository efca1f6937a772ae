"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from changelake.llm.common import discard, store


def _step(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The stored edges, and a print of them that is taken as they are written."""
    seen = Observation()
    marks = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")
    stored = store(edges.observe(seen, F.count("*").alias("n"), marks), "stars")
    return stored, (seen.get["n"], seen.get["hashes"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node on an edge; the component is its smallest node.

    ``edges`` has two columns of one type; loops and nulls are left out, so an empty table gives
    an empty one. Each round keeps for every node only links to the smallest neighbour: aggregates
    combine before the shuffle, and no neighbour list is ever collected. Rounds grow with the
    logarithm of the longest path; each is written to the shared folder, and deleted after the next.
    The result can be discarded as a stored step can.
    """
    a, b = (F.col(name) for name in edges.columns)
    current, seen = _step(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low).distinct())
        before = current
        current, now = _step(small)
        discard(before)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("id")).distinct()
    found = current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        roots.select("id", F.col("id").alias("component")))
    found.stored_at = current.stored_at
    return found
