"""Mixing sources to target weights by weighted fair queueing.

The words of all documents are the budget. Sources share it by weight; a source whose share would
take more than ``repeats`` times its words stops there, and the others share the rest by weight
until nothing is above. Each source then queues its documents, shuffled, once for each repeat. A
document's virtual finish time is the words its source has queued up to its end, over the source's
target; a document that is being served when its source's target is reached (time 1) is cut there.
The queue is sorted by finish time over all sources and truncated at the budget, so each source is
served within one word of its target.

Only built-in functions: the text is read once for its word count and digest, and rows of a few
numbers move from there on. A source of any size is cut into slices of its shuffled order, so no
task holds a source; the queue is cut by ranges of finish time, and only the range that holds the
budget's end is numbered row by row. Targets come from a few sums over the sources' table.

A null text has no words, a null source is a source of its own and comes last, a null doc_id is
kept. Rows with equal id and text are documents of their own; as they are alike, it does not matter
which is served first. Documents without words, and tables without any, take nothing. Only the
columns doc_id, text and source are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelake.llm.common import hinted, store

SPACE = r"\x20\x09-\x0D"
# Rows of a source that one window sorts, about.
SLICE_ROWS = 1 << 18


@dataclass
class Mix:
    """``documents``: every document with its source's figures and the words the mix takes of it.
    ``queue``: the pieces of the mix, with ``mark`` (digest of id and text), ``repeat``, ``first``
    (words before it in the document), ``words`` and ``finish``, by which it is sorted."""

    documents: DataFrame
    queue: DataFrame


def n_words(text: Column) -> Column:
    """Maximal runs of characters that are no ASCII white space; 0 for null."""
    one = F.regexp_replace(text, f"[{SPACE}]*[^{SPACE}]+[{SPACE}]*", "x")
    return F.when(text.rlike(f"[^{SPACE}]"), F.length(one)).otherwise(0).cast("long")


def digest(doc_id: Column, text: Column, seed: str) -> Column:
    """Where a document stands in the shuffled order of its source."""
    cells = [F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, text)]
    return F.md5(F.concat(F.lit(f"{seed}:"), cells[0], F.lit(":"), cells[1]).cast("binary"))


def _ranked(totals: DataFrame) -> DataFrame:
    """Sources numbered from 0 by code point, null last, without one task that sees them all."""
    order = F.col("source").asc_nulls_last()
    ranged = store(totals.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row a partition of the shuffle.
    starts = ranged.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1 + F.col("start")
    return ranged.join(F.broadcast(starts), "part").withColumn("rank", number.cast("long")).drop("part", "start")


def targets(totals: DataFrame, weights: Sequence[int], repeats: int, budget: int) -> DataFrame:
    """``totals`` (source, source_size, ...) with ``rank``, ``weight`` and ``target``."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = store(_ranked(totals).withColumns({"weight": weight.cast("long"),
                                                "most": F.col("source_size") * repeats}), "weights")
    rest, shares = budget, ranked.agg(F.sum("weight")).first()[0] or 0
    while True:
        exact = "decimal(18,0)"
        full = (F.col("most").cast(exact) * F.lit(shares).cast(exact)
                <= F.col("weight").cast(exact) * F.lit(rest).cast(exact))
        row = ranked.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        now = budget - (row[0] or 0), row[1] or 0
        if now == (rest, shares):
            break
        rest, shares = now
    share = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(max(shares, 1))
    return ranked.withColumn("target", F.when(full, F.col("most").cast("double")).otherwise(share)).drop("most")


def _placed(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """Documents with ``start``: the words that their source queues before them."""
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / SLICE_ROWS))).cast("int")
    side = shares.withColumn("bits", bits).drop("weight", "rows").withColumnRenamed("source", "_source")
    spread = F.conv(F.substring("mark", 1, 15), 16, 10).cast("long")
    rows = sized.join(hinted(side, F.lit(64) + F.coalesce(F.length("_source"), F.lit(0))),
                      F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_spread", spread).withColumn("slice", F.expr("shiftright(_spread, 60 - bits)"))
    slices = rows.groupBy("rank", "slice").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("rank").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = slices.select("rank", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = (W.partitionBy("rank", "slice").orderBy("mark", "doc_id", "size")
              .rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts, ["rank", "slice"]).withColumn("start", F.col("start") + F.col("base")).drop(
        "_spread", "slice", "bits", "base")


def _pieces(placed: DataFrame, repeats: int) -> DataFrame:
    """What may be served: documents up to the word that reaches their source's target."""
    begin = F.col("repeat") * F.col("source_size") + F.col("start")
    copies = placed.where("size > 0 and target > 0").withColumns(
        {"low": F.floor("target"), "high": F.ceil("target"), "repeat": F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))})
    copies = copies.withColumns({"begin": begin, "end": begin + F.col("size")}).where("begin < high")

    def piece(start: Column, stop: Column, real: Column) -> Column:
        return F.when(real, F.struct(start.alias("begin"), stop.alias("end")))

    low, high, end = F.col("low"), F.col("high"), F.col("end")
    cut = F.array_compact(F.array(
        piece(F.col("begin"), F.least(end, low), F.col("begin") < low),
        piece(low, high, (high > low) & (F.col("begin") <= low) & (end > low))))
    return copies.withColumn("piece", F.explode(cut)).select(
        "doc_id", "source", "mark", "rank", "repeat", F.col("piece.begin").alias("place"),
        (F.col("piece.begin") - F.col("begin")).alias("first"),
        (F.col("piece.end") - F.col("piece.begin")).alias("words"),
        (F.col("piece.end").cast("double") / F.col("target")).alias("finish"))


def _truncated(pieces: DataFrame, budget: int) -> DataFrame:
    """The queue in order of finish time, up to ``budget`` words."""
    order = ["finish", "rank", "place"]
    queue = store(pieces.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("part", F.spark_partition_id()), "queue")
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row a partition of the shuffle.
    parts = queue.groupBy("part").agg(F.sum("words").alias("words")).withColumn(
        "before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    last = parts.where((F.col("before") < budget) & (F.col("before") + F.col("words") >= budget)).head()
    if last is None:
        return queue.drop("part")
    served = F.sum("words").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    edge = queue.where(F.col("part") == last["part"]).withColumn("served", F.coalesce(served, F.lit(0)) + last["before"])
    edge = edge.where(F.col("served") < budget).withColumn(
        "words", F.least("words", F.lit(budget) - F.col("served"))).drop("served")
    return queue.where(F.col("part") < last["part"]).unionByName(edge).drop("part")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), repeats: int = 3, budget: int | None = None,
        seed: str = "mix") -> Mix:
    """The mix of ``budget`` words (all there are, unless given). Sources in order of their names
    weigh ``weights``, repeating; no document is used more than ``repeats`` times."""
    sized = store(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                              digest(F.col("doc_id"), F.col("text"), seed).alias("mark")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    if budget is None:
        budget = sized.agg(F.sum("size")).first()[0] or 0
    placed = store(_placed(sized, targets(totals, weights, repeats, budget)), "placed")
    queue = store(_truncated(_pieces(placed, repeats), budget), "served")
    served = store(queue.groupBy("rank").agg(F.sum("words").alias("served")), "served_words")
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce("served", F.lit(0))
                                               - F.col("source_size") * i - F.col("start")))
                 for i in range(repeats)), F.lit(0))
    documents = placed.join(hinted(served, F.lit(16)), "rank", "left").select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "mark")
    return Mix(documents, queue.drop("place"))


def texts(docs: DataFrame, queue: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: ``text`` of every piece of the queue, sorted as it is served.

    A piece that is not a whole document has its words joined by one space.
    """
    own = docs.select("source", "text", digest(F.col("doc_id"), F.col("text"), seed).alias("mark")).withColumns(
        {"_source": F.col("source")}).drop("source").dropDuplicates(["mark", "_source"])
    found = queue.join(own, (queue["mark"] == own["mark"]) & queue["source"].eqNullSafe(own["_source"])).drop(
        own["mark"], "_source")
    words = F.regexp_extract_all("text", F.lit(f"([^{SPACE}]+)"))
    part = F.array_join(F.slice(words, (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ")
    whole = (F.col("first") == 0) & (F.col("words") == n_words(F.col("text")))
    return found.withColumn("text", F.when(whole, F.col("text")).otherwise(part)).sort("finish", "rank", "first")
