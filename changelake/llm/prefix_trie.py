"""A trie of conversations by shared first turns, with totals of every subtree by tree contraction.

A prefix of ``d`` turns is known by 128 bits: the exclusive or of a hash of (place, role, text) over
its turns, so prefixes of a conversation of any length are running totals that slices carry over.
Nodes are distinct prefixes, one aggregate over all of them; a node is named (smallest member,
depth), so each conversation has a path of nodes that carry its name.

Subtree totals come from rounds that shrink the tree. *Rake*: leaves hand their total to their parent,
summed before the shuffle. *Compress*: along the paths, runs of nodes with one child give way to the
node below them, which keeps what they would add; a run is cut at slices of ``SLICE`` depths, and
slices widen by that factor each round, so a chain of any length shrinks in tasks of bounded size. The
nodes left halve at least; the rounds grow with the logarithm of the tree. Then the contracted nodes come
back, last round first: each one's total is that of the node it gave way to and what was kept for it.

Turns of one number follow by role and text, null turns come first, null roles and texts are empty.
Rows without a conv_id take no part. Repeated rows are turns of their own. Very long conversations and
turns need no task that holds them. Only the columns conv_id, turn, role and text are read, so others
cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelake.functions.ordering import running_totals
from changelake.llm.common import hinted, prepare, store

FAMILY, LEADING = 5, 9
# Turns or nodes of one window at most, before the slices widen.
SLICE = 4096
# Ids that one task joins to text at a time.
IDS = 1 << 16
NODE = ["conv_id", "depth"]


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns by place from 1 in their conversation, as digests: conv_id, pos, turn_hash, bytes."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    placed = running_totals(rows, ["conv_id"], ["turn", "role", "text"], {"pos": F.lit(1).cast("long")})
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return placed.select("conv_id", "pos", F.md5(content.cast("binary")).alias("turn_hash"),
                         F.octet_length("text").cast("long").alias("bytes"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their family, and their lengths.

    Conversation c takes the first h = crc32(c) % LEADING turns of c - c % FAMILY in place of its own
    first h. Returns (conv_id, depth, turn_hash, bytes) and (conv_id, length).
    """
    sizes = store(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "lengths")
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEADING).alias("h")
    plan = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), taken)
    plan = plan.join(sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("available")), "first", "left")
    plan = store(plan.withColumn("m", F.least("h", F.coalesce("available", F.lit(0)))), "families")
    shared = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < LEADING)).withColumnRenamed("conv_id", "first")
    begin = plan.select("first", "conv_id", "h").join(shared, "first").where("pos <= h")
    own = turns.join(plan.select("conv_id", "h", "m"), "conv_id").where("pos > h")
    rows = begin.select("conv_id", F.col("pos").alias("depth"), "turn_hash", "bytes").union(
        own.select("conv_id", F.col("m") + F.col("pos") - F.col("h"), "turn_hash", "bytes"))
    return rows, plan.select("conv_id", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def prefixes(rows: DataFrame) -> DataFrame:
    """Every prefix of every conversation: conv_id, depth, its hash (a, b), its parent's (pa, pb), bytes."""
    hashed = rows.withColumns({
        "ha": F.xxhash64(F.lit(1), "depth", "turn_hash"), "hb": F.xxhash64(F.lit(2), "turn_hash", "depth"),
        "slice": F.expr(f"(depth - 1) div {SLICE}")})
    so_far = W.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inside = hashed.withColumns({"a": F.bit_xor("ha").over(so_far), "b": F.bit_xor("hb").over(so_far)})
    later = W.partitionBy("conv_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = hashed.groupBy("conv_id", "slice").agg(F.bit_xor("ha").alias("ha"), F.bit_xor("hb").alias("hb"))
    carried = store(slices.select("conv_id", "slice", F.bit_xor("ha").over(later).alias("ca"),
                                  F.bit_xor("hb").over(later).alias("cb")).where("slice > 0"), "carried")
    found = inside.join(hinted(carried, F.lit(32)), ["conv_id", "slice"], "left")
    zero = F.lit(0).cast("long")
    a = F.col("a").bitwiseXOR(F.coalesce("ca", zero))
    b = F.col("b").bitwiseXOR(F.coalesce("cb", zero))
    return found.select("conv_id", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("ha")).alias("pa"),
                        b.bitwiseXOR(F.col("hb")).alias("pb"), "bytes")


def _streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of joined id lists whose parts come in order; no list is ever whole in memory."""
    key, digest = None, None
    for frame in frames:
        done = []
        for a, b, ids in zip(frame["a"], frame["b"], frame["ids"], strict=True):
            if key != (a, b):
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pd.DataFrame(done, columns=["a", "b", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=["a", "b", "ends_sha256"])


def ends(last: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the nodes where conversations end; ``last`` has conv_id, a, b.

    Ids are joined to text by blocks of numbers, in parallel; only nodes with several blocks need
    one task that runs over their blocks in order.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    block = F.floor(F.col("conv_id") / F.lit(IDS)).alias("block")
    parts = store(last.groupBy("a", "b", block).agg(ids.alias("ids")), "ends")
    counts = parts.groupBy("a", "b").agg(F.count(F.lit(1)).alias("blocks"), F.max("ids").alias("ids"))
    one = counts.where("blocks = 1").select("a", "b", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    several = parts.join(counts.where("blocks > 1").select("a", "b"), ["a", "b"])
    streamed = several.repartition("a", "b").sortWithinPartitions("a", "b", "block").mapInPandas(
        _streamed, "a BIGINT, b BIGINT, ends_sha256 STRING")
    return one.union(streamed)


def _compressed(tree: DataFrame, width: int, measures: list[str]) -> DataFrame:
    """The tree with ``target`` (and what is to be added) for nodes that gave way to the one below."""
    path = W.partitionBy("node.conv_id", F.expr(f"node.depth div {width}")).orderBy("node.depth")
    below = F.lead(F.struct("node", "parent")).over(path)
    gone = F.coalesce((F.col("kids") == 1) & F.col("parent").isNotNull() & (F.col("_below.parent") == F.col("node")),
                      F.lit(False))
    marked = tree.withColumn("_below", below).withColumn("gone", gone).withColumn("run", F.coalesce(
        F.sum(F.when(F.col("gone"), 0).otherwise(1)).over(path.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    run = W.partitionBy("node.conv_id", F.expr(f"node.depth div {width}"), "run").orderBy("node.depth")
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    here, after = run.rowsBetween(0, W.unboundedFollowing), run.rowsBetween(1, W.unboundedFollowing)
    cells = {"target": F.when(F.col("gone"), F.last("node").over(whole)),
             "parent": F.when(F.col("gone"), F.col("parent")).otherwise(F.first("parent").over(whole))}
    for m in measures:
        own = F.when(F.col("gone"), F.col(m)).otherwise(0)
        cells[f"add_{m}"] = F.sum(own).over(here) + F.coalesce(F.sum(f"over_{m}").over(after), F.lit(0))
        cells[f"all_{m}"] = F.sum(own + F.col(f"over_{m}")).over(whole)
    closed = marked.withColumns(cells)
    for m in measures:
        closed = closed.withColumn(f"over_{m}", F.col(f"all_{m}")).drop(f"all_{m}")
    return closed.drop("_below", "gone", "run")


def subtree_sums(tree: DataFrame, measures: list[str]) -> DataFrame:
    """(node, measures): sums over every node's subtree.

    ``tree`` has node and parent (structs of conv_id and depth; the root's parent is null), ``kids``
    and the measures.
    """
    tree = tree.withColumns({f"over_{m}": F.lit(0).cast("long") for m in measures})
    width, rounds = SLICE, []
    while True:
        rounds.append(store(_compressed(tree, width, measures), "contracted"))
        left = rounds[-1].where("target is null").drop("target", *(f"add_{m}" for m in measures))
        inner = left.where("kids > 0")
        if inner.isEmpty():
            break
        given = left.where("kids = 0 and parent is not null").groupBy(F.col("parent").alias("node")).agg(
            F.count(F.lit(1)).alias("_raked"), *(F.sum(F.col(m) + F.col(f"over_{m}")).alias(f"_{m}") for m in measures))
        tree = inner.join(given, "node", "left").withColumns(
            {"kids": F.col("kids") - F.coalesce("_raked", F.lit(0)),
             **{m: F.col(m) + F.coalesce(f"_{m}", F.lit(0)) for m in measures}}).drop(
            "_raked", *(f"_{m}" for m in measures))
        width = min(width * SLICE, 1 << 62)
    totals = reduce(DataFrame.union, [r.where("target is null and kids = 0").select("node", *measures) for r in rounds])
    for contracted in reversed(rounds):
        below = totals.select(F.col("node").alias("target"), *(F.col(m).alias(f"_{m}") for m in measures))
        back = contracted.where("target is not null").join(below, "target").select(
            "node", *((F.col(f"_{m}") + F.col(f"add_{m}")).alias(m) for m in measures))
        totals = totals.union(store(back, "expanded"))
    return totals


def trie(conversations: DataFrame) -> DataFrame:
    """Every node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256."""
    prepare(conversations.sparkSession)
    rows, lengths = rebuilt(store(numbered(conversations), "turns"))
    rows = store(prefixes(rows), "prefixes")
    zero = F.lit(0).cast("long")
    root = lengths.select("conv_id", zero.alias("depth"), *(zero.alias(c) for c in ("a", "b")),
                          *(F.lit(None).cast("long").alias(c) for c in ("pa", "pb")), zero.alias("bytes"))
    nodes = store(rows.union(root).groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        *(F.max(c).alias(c) for c in ("pa", "pb", "bytes"))), "nodes")
    # Children of the root share its one row; all others meet their parent in a join.
    top = F.broadcast(nodes.where("depth = 0").select(F.col("conv_id").alias("parent_conv_id")))
    over = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    linked = (nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
              .unionByName(nodes.where("depth = 1").join(top, F.lit(True)))
              .unionByName(nodes.where("depth > 1").join(over, ["pa", "pb"])))
    linked = store(linked.withColumns({
        "node": F.struct(*NODE), "parent": F.when(F.col("depth") > 0, F.struct(
            F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")))}), "linked")
    kids = linked.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = store(linked.join(kids, "node", "left").na.fill(0, ["n_children"]), "counted")
    sums = subtree_sums(counted.select(
        "node", "parent", F.col("n_children").alias("kids"), (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    last = rows.join(lengths.withColumnRenamed("length", "depth"), NODE).select("conv_id", "a", "b").union(
        lengths.where("length = 0").select("conv_id", zero, zero))
    return counted.join(sums, "node").join(ends(last), ["a", "b"], "left").select(
        *NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
