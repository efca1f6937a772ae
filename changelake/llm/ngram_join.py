"""Exact n-gram Jaccard self-join with a count-vector R-tree.

Shingles are hashed into groups; the numbers of shingles in each group make a set a point. Two sets
share at most the sum of the smaller coordinates, and a tree node bounds this for all points below
it by its largest coordinates. Pairs that survive the bound are verified on the whole sets.

The tree alone would compare every set with all sets of a similar size, so sets meet in blocks
first. A pair at the threshold differs in a known number d of shingles; with more than d groups, one
group at least holds the same shingles in both. A block is the sets (of similar size) that agree
in one group, so each pair that links meets in a block. There are some more groups than d + 1, and a
pair agrees in that many more; so each set leaves its largest blocks, which are those of passages
that many texts share, and a pair that links still meets (``_rare``). Each block's first member is
compared with the others, which unites most of what links. Blocks that share members form a cluster;
the members of a cluster, or of each block where that is less, whose sizes are close and that still
lie in different components are searched with the tree, in tiles, and verified where they meet: a
tile gives the links that unite components, not all.
"""

from __future__ import annotations

import functools
import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelake.llm.common import discard, hinted, lean, longs, mix, prepare, span_hash, store, texts, tidy, words
from changelake.llm.graph import components

TILE = 2048
LEAF = 16
# Pairs in a tile that take as long as a row of it.
ROW = 200
# The lowest bits of a mark, which stay in the names of blocks.
TAG = np.uint64(3)
# Bytes of an Arrow batch: shingles and counts take several times their text.
BATCH = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Shingles of ``size`` words; sets link if over * |intersection| >= part * |union|."""

    size: int = 4
    part: int = 85
    over: int = 100

    def shared(self, a, b):
        """The least intersection of linked sets of a and b shingles."""
        return -(-self.part * (a + b) // (self.over + self.part))

    @functools.cached_property
    def classes(self) -> np.ndarray:
        """Least sizes of the size classes: linked sets lie in one class or in neighbouring ones."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, out[-1] * self.over // self.part + 1))
        return np.array(out)

    @functools.cached_property
    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(groups, empty groups that may be) for pairs whose larger set is in a class; 0 if it has none.

        Sets of the class and of the one below differ in d shingles at most, which leaves as many
        groups alike as there are above d. Some of these may be empty in both, so there are more; a
        set with more empty groups than that belongs to an extra block with others of its kind.
        """
        counts, spares = [], []
        for number in range(len(self.classes) - 1):
            largest, smallest = int(self.classes[number + 1]) - 1, int(self.classes[max(0, number - 1)])
            apart = 2 * largest * (self.over - self.part) // (self.over + self.part)
            spare = 2
            for _ in range(4):
                empty = (apart + 1 + spare) * math.exp(-smallest / (apart + 1 + spare))
                spare = max(2, min(apart + 2, math.ceil(empty + 3 * math.sqrt(empty))))
            counts.append(apart + 1 + spare if apart else 0)
            spares.append(spare)
        return np.array(counts), np.array(spares)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingles of each text; few words are one shingle."""
    starts, stops, first = words(data, offsets)
    hashing = span_hash(202, fold=True)
    word = hashing.spans(hashing.sums(data), starts, stops)
    step, joined = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(word), np.uint64)
    full = max(0, len(word) - size + 1)
    for j in range(size):
        joined[:full] = mix(joined[:full] * step + word[j:j + full])
    new = np.zeros(len(word), bool)
    for low, high in zip(first.tolist(), first[1:].tolist(), strict=False):
        if high - low >= size:
            joined[low:high - size + 1].sort()
            new[low:high - size + 1] = True
        elif high > low:
            value = np.array([high - low], np.uint64)
            for w in word[low:high]:
                value = mix(value * step + w)
            joined[low], new[low] = value[0], True
    again = np.zeros(len(word), bool)
    again[1:] = (joined[1:] == joined[:-1]) & new[:-1]
    again[first[:-1][first[:-1] < len(word)]] = False
    new &= ~again
    return joined[new], np.concatenate([[0], np.cumsum(new)])[first]


def _grouped(tokens: np.ndarray, bounds: np.ndarray, number: np.ndarray, rule: Rule):
    """(shingle, first shingle of each group that holds any, set of these, group) for a class of each set."""
    sizes = np.diff(bounds)
    count = rule.groups[0][number]
    chosen = np.flatnonzero(np.repeat(count > 0, sizes))
    of = np.repeat(np.arange(len(sizes)), sizes)[chosen]
    # Groups are equal ranges of the hash, and shingles are in its order.
    group = ((tokens[chosen] >> np.uint64(32)) * count[of].astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(of), bool)
    new[1:] = (group[1:] != group[:-1]) | (of[1:] != of[:-1])
    begins = np.flatnonzero(new)
    return chosen, begins, of[begins], group[begins]


def _class_numbers(sizes: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """The class of each set and the one above; 0, which has no groups, for empty sets."""
    own = np.searchsorted(rule.classes, sizes, "right") - 1
    return [np.where(sizes > 0, number, 0) for number in (own, own + 1)]


def group_marks(tokens: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(hash of what a set holds in a group, set) for the class of each set and the one above.

    The lowest bit of a hash is that of its class, the next one tells the extra blocks.
    """
    sizes = np.diff(bounds)
    counts, spares = rule.groups
    mixed = mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    out, sets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for number in _class_numbers(sizes, rule):
        count = counts[number]
        chosen, begins, of, group = _grouped(tokens, bounds, number, rule)
        if not len(chosen):
            continue
        held = np.add.reduceat(mixed[chosen], begins)
        held ^= group << np.uint64(8)
        held ^= number[of].astype(np.uint64) << np.uint64(40)
        out.append(mix(held) & ~TAG | (number[of] & 1).astype(np.uint64))
        sets.append(of)
        sparse = np.flatnonzero((count > 0) & (count - np.bincount(of, minlength=len(sizes)) > spares[number]))
        number = number[sparse].astype(np.uint64)
        out.append(mix(number + np.uint64(1 << 50)) & ~TAG | np.uint64(2) | number & np.uint64(1))
        sets.append(sparse)
    return np.concatenate(out), np.concatenate(sets)


def group_rests(tokens: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """How many of its marks each set may leave out, of its even and of its odd class.

    Linked sets agree in one group more than there are spare ones. Some of these may be empty in both:
    so the pair has one mark more in common than either may leave out, and if both leave those out that
    come last in one order of all marks, they keep one that they share.
    """
    sizes = np.diff(bounds)
    out = np.zeros((2, len(sizes)), np.int64)
    for number in _class_numbers(sizes, rule):
        _, _, of, _ = _grouped(tokens, bounds, number, rule)
        empty = rule.groups[0][number] - np.bincount(of, minlength=len(sizes))
        out[number & 1, np.arange(len(sizes))] = np.maximum(0, rule.groups[1][number] - empty)
    return out[0], out[1]


def point(tokens: np.ndarray) -> np.ndarray:
    """Counts by group of a set, at a power of two of groups that holds about six in each."""
    count = 1 << max(0, (len(tokens) // 4).bit_length() - 1)
    shift = 64 - (count.bit_length() - 1)
    where = (tokens >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(tokens), np.int64)
    return np.minimum(np.bincount(where, minlength=count), 65535).astype(np.uint16)


def coarsened(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.reshape(groups, -1).sum(1).astype(np.int32) if len(counts) > groups else counts.astype(np.int32)


class CountTree:
    """An R-tree over count vectors, bulk loaded by sorting; nodes know their largest coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order, self.points, self.sizes = np.arange(len(points)), points, sizes
        self.levels: list = []  # (largest coordinates, least size) by node, leaves first
        if len(points) <= LEAF:  # one leaf: its points are looked at one by one
            return
        # Neighbours in the order of coarser and coarser counts share leaves.
        halves = [points.reshape(len(points), g, -1).sum(2) for g in (8, 4, 2) if points.shape[1] >= g]
        keys = [column for h in halves for column in h.T[::-1]] + [sizes]
        self.order = np.lexsort(keys)
        self.points, self.sizes = points[self.order], sizes[self.order]
        tops, least = self.points, self.sizes
        while len(tops) > 1:
            cuts = np.arange(0, len(tops), LEAF)
            tops, least = np.maximum.reduceat(tops, cuts, axis=0), np.minimum.reduceat(least, cuts)
            self.levels.append((tops, least))

    def survivors(self, probe: np.ndarray, size: int, rule: Rule) -> np.ndarray:
        """Numbers of the points whose bound allows a link with a set of ``size`` at ``probe``."""
        nodes = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, least = self.levels[depth]
            held = np.minimum(tops[nodes], probe).sum(1) >= rule.shared(size, least[nodes])
            nodes = nodes[held]
            width = len(self.levels[depth - 1][0]) if depth else len(self.points)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < width]
        held = np.minimum(self.points[nodes], probe).sum(1) >= rule.shared(size, self.sizes[nodes])
        return self.order[nodes[held]]


# -- Spark steps

class _Seen:
    def __init__(self, limit: int):
        self.limit, self.items = limit, set()

    def fresh(self, item) -> bool:
        if item in self.items:
            return False
        if len(self.items) >= self.limit:
            self.items.clear()
        self.items.add(item)
        return True


def _digests(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    data, places = tokens.tobytes(), (8 * bounds).tolist()
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(places, places[1:], strict=False)]


def _sets(documents: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n, digest, even, odd) of every row; the digest tells sets apart. See ``group_rests``."""
    def run(batches):
        for batch in batches:
            sizes, digests, rests = [], [], [np.zeros((2, 0), np.int64)]
            for _, data, offsets in texts(batch.column("text")):
                tokens, bounds = shingles(data, offsets, rule.size)
                sizes.append(np.diff(bounds))
                digests += _digests(tokens, bounds)
                rests.append(np.array(group_rests(tokens, bounds, rule)))
            even, odd = np.concatenate(rests, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(even), pa.array(odd)],
                ["doc_id", "n", "digest", "even", "odd"])

    return documents.mapInArrow(lean(run), "doc_id long, n long, digest binary, even long, odd long")


def _marks(documents: DataFrame, rule: Rule) -> DataFrame:
    """(mark, doc_id): the blocks of each set; equal sets of a task give theirs once."""
    def run(batches):
        seen = _Seen(500_000)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for row, data, offsets in texts(batch.column("text")):
                tokens, bounds = shingles(data, offsets, rule.size)
                fresh = np.array([seen.fresh(d) for d in _digests(tokens, bounds)])
                tokens = tokens[np.repeat(fresh, np.diff(bounds))]
                sizes = np.where(fresh, np.diff(bounds), 0)
                marks, owner = group_marks(tokens, np.concatenate([[0], np.cumsum(sizes)]), rule)
                if len(marks):
                    yield pa.RecordBatch.from_arrays([longs(marks), pa.array(ids[row + owner])], ["mark", "doc_id"])

    return documents.mapInArrow(lean(run), "mark long, doc_id long")


def _blocks(marks: DataFrame) -> DataFrame:
    """(block, doc_id, marks): members of each mark that several rows have, equal blocks once; and, without
    a doc_id, how many marks a block stands for.

    Rows come in the order of (mark, doc_id). A block with the members of one before it is the same
    block; one that does not fit the buffer keeps its mark as name and is passed on as it comes.
    """
    def run(batches):
        named, most, buffered = {}, 300_000, 200_000
        held_marks = held_docs = np.zeros(0, np.int64)
        streaming = None  # the open mark, if its rows are more than the buffer holds

        def rows(block, docs, number):
            return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(docs, pa.int64()), pa.array(number, pa.int64())],
                                              ["block", "doc_id", "marks"])

        def counted():
            names = list(named)
            out = rows(names, [None] * len(names), [named[n] for n in names])
            named.clear()
            return out

        def closed(marks, docs):
            """Blocks of marks that are there as a whole."""
            new = np.ones(len(marks), bool)
            new[1:] = (marks[1:] != marks[:-1]) | (docs[1:] != docs[:-1])
            marks, docs = marks[new], docs[new]
            starts = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]])) if len(marks) else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate([starts, [len(marks)]]))
            several = sizes > 1
            if not several.any():
                return None
            of = np.repeat(several, sizes)
            marks, docs, sizes = marks[of], docs[of], sizes[several]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            sums = np.add.reduceat(mix(docs.view(np.uint64)), starts)
            names = (mix(sums) & ~TAG | marks[starts].view(np.uint64) & TAG).view(np.int64)
            names, first, number = np.unique(names, return_index=True, return_counts=True)
            fresh = []
            for name, place, n in zip(names.tolist(), first.tolist(), number.tolist(), strict=True):
                if name in named:
                    named[name] += n
                else:
                    named[name] = n
                    fresh.append(place)
            if not fresh:
                return None
            fresh = np.array(fresh)
            chosen = np.zeros(len(sizes), bool)
            chosen[fresh] = True
            name = np.zeros(len(sizes), np.int64)
            name[first] = names
            of = np.repeat(chosen, sizes)
            return rows(np.repeat(name, sizes)[of], docs[of], np.zeros(int(of.sum()), np.int64))

        for batch in batches:
            marks, docs = batch.column("mark").to_numpy(), batch.column("doc_id").to_numpy()
            if not len(marks):
                continue
            if streaming is not None:
                same = int(np.searchsorted(marks != streaming, True))
                if same:
                    yield rows(np.full(same, streaming), docs[:same], np.zeros(same, np.int64))
                marks, docs = marks[same:], docs[same:]
                if not len(marks):
                    continue
                streaming = None
            marks, docs = np.concatenate([held_marks, marks]), np.concatenate([held_docs, docs])
            last = int(np.searchsorted(marks == marks[-1], True))
            found = closed(marks[:last], docs[:last])
            if found is not None:
                yield found
            held_marks, held_docs = marks[last:], docs[last:]
            if len(held_docs) > buffered:
                streaming = int(held_marks[0])
                named[streaming] = named.get(streaming, 0) + 1
                yield rows(held_marks, held_docs, np.zeros(len(held_docs), np.int64))
                held_marks = held_docs = np.zeros(0, np.int64)
            if len(named) >= most:
                yield counted()
        found = closed(held_marks, held_docs)
        if found is not None:
            yield found
        yield counted()

    return (marks.repartition("mark").sortWithinPartitions("mark", "doc_id")
            .mapInArrow(lean(run), "block long, doc_id long, marks long"))


def _rare(members: DataFrame, marks: DataFrame, rests: DataFrame) -> DataFrame:
    """(block, leader, doc_id): blocks without the members that need not meet there; equal blocks once.

    ``members`` (block, doc_id) are distinct, ``marks`` has the number of marks of each block, ``rests`` (doc_id,
    even, odd) how many a set may leave out: it leaves those of its largest blocks. Sets without rests
    stay in all blocks. The order is that of (members, name of the block), which is the same for all sets.
    """
    sizes = members.groupBy("block").agg(F.count("*").alias("size")).where("size > 1").join(marks, "block")
    extra = F.col("block").bitwiseAND(F.lit(2)) != 0
    largest = Window.partitionBy("doc_id", F.col("block").bitwiseAND(F.lit(1))).orderBy(F.desc("size"), F.desc("block")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rest = F.when(F.col("block").bitwiseAND(F.lit(1)) == 0, F.col("even")).otherwise(F.col("odd"))
    kept = (members.join(sizes, "block").join(rests, "doc_id", "left")
            .withColumn("over", F.sum(F.when(extra, 0).otherwise(F.col("marks"))).over(largest))
            .where(extra | (F.col("over") > F.coalesce(rest, F.lit(0)))).select("block", "doc_id"))
    kept = store(kept, "kept")
    # Members tell blocks apart from here on.
    named = (kept.groupBy("block").agg(F.count("*").alias("size"), F.min("doc_id").alias("leader"),
                                       F.bit_xor(F.xxhash64("doc_id")).alias("a"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("b"))
             .where("size > 1").groupBy("size", "leader", "a", "b").agg(F.min("block").alias("block")).select("block", "leader"))
    found = store(kept.join(named, "block").select("block", "leader", "doc_id"), "blocks")
    discard(kept)
    return found


def _tokens(documents: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, tokens, counts): sorted shingle hashes and count vector of chosen sets."""
    def run(batches):
        for batch in batches:
            tokens, counts = [], []
            for _, data, offsets in texts(batch.column("text")):
                found, bounds = shingles(data, offsets, rule.size)
                for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                    tokens.append(found[a:b].tobytes())
                    counts.append(point(found[a:b]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.binary()),
                                              pa.array(counts, pa.binary())], ["doc_id", "tokens", "counts"])

    return documents.mapInArrow(lean(run), "doc_id long, tokens binary, counts binary")


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose whole sets link; the count bound comes before the sets are read."""
    def bound(batches):
        for batch in batches:
            keep = []
            for x, y, m, n in zip(*(batch.column(c).to_pylist() for c in ("ca", "cb", "na", "nb")), strict=True):
                x, y = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
                groups = min(len(x), len(y))
                need = rule.shared(m, n)
                keep.append(min(m, n) >= need and
                            int(np.minimum(coarsened(x, groups), coarsened(y, groups)).sum()) >= need)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(_shared(x, y) >= rule.shared(len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    light = sets.select("doc_id", "counts", "n")
    near = (pairs.join(light.toDF("b", "cb", "nb"), "b").join(light.toDF("a", "ca", "na"), "a")
            .select("a", "b", "ca", "cb", "na", "nb").mapInArrow(lean(bound), "a long, b long"))
    whole = sets.select("doc_id", "tokens")
    return (near.join(whole.toDF("b", "tb"), "b").join(whole.toDF("a", "ta"), "a")
            .select("a", "b", "ta", "tb").mapInArrow(lean(exact), "a long, b long"))


def _similar_sizes(clusters: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(block, cluster, doc_id, n): members of a cluster whose sizes allow a link, each with its class and the next."""
    bounds = F.array(*(F.lit(int(x)) for x in rule.classes))
    own = F.size(F.filter(bounds, lambda x: x <= F.col("n")))
    return (sets.select("doc_id", "n").join(clusters, "doc_id")
            .select(F.explode(F.array(own, own + 1)).alias("number"), "cluster", "doc_id", "n")
            .select(F.xxhash64("cluster", "number").alias("block"), "cluster", "doc_id", "n"))


def _searched(blocks: DataFrame, clusters: DataFrame, parts: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(block, doc_id, n): where members in several components are searched. In blocks that share members many
    pairs meet more than once; in a cluster, which is all blocks that do, each meets once, with others
    that no block holds together. Of the two each cluster takes the one with less to do.
    """
    def work(rows, name):
        held = (rows.join(parts, "doc_id", "left").groupBy("cluster", "block", F.coalesce("component", "doc_id").alias("component"))
                .agg(F.count("*").alias("m")).groupBy("cluster", "block").agg(
                    F.count("*").alias("kinds"), F.sum("m").alias("m"), F.max("m").alias("top")).where("kinds > 1"))
        return held.groupBy("cluster").agg(F.sum(F.col("m").cast("double") * (F.col("m") - F.col("top") + ROW)).alias(name))

    own = (sets.select("doc_id", "n").join(blocks.select("block", "doc_id"), "doc_id").join(clusters, "doc_id")
           .select("block", "cluster", "doc_id", "n"))
    whole = _similar_sizes(clusters, sets, rule)
    less = store(work(whole, "whole").join(work(own, "own"), "cluster").select("cluster", F.expr("whole <= own").alias("as_one")), "less")
    found = store(whole.join(less.where("as_one"), "cluster").union(own.join(less.where("not as_one"), "cluster").select(*whole.columns, "as_one"))
                  .select("block", "doc_id", "n"), "searched")
    discard(less)
    return found


def _across(blocks: DataFrame, parts: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links between different components of a block; enough of them to unite what links unite.

    Members of a block's largest component meet the others, the others meet each other too; both in
    tiles of about 2,048 rows and two million shingles a side, so that no task takes a whole block.
    """
    placed = blocks.join(parts, "doc_id", "left").select(
        "block", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    weight = F.greatest(F.count("*") / TILE, F.sum("n") / (1000 * TILE))
    sizes = (placed.groupBy("block", "component").agg(weight.alias("weight"))
             .groupBy("block").agg(F.count("*").alias("kinds"), F.sum("weight").alias("total"),
                                   F.max(F.struct("weight", F.negative("component").alias("c"))).alias("top"))
             .where("kinds > 1").select("block", F.negative("top.c").alias("major"),
                                        F.ceil("top.weight").cast("int").alias("wide"),
                                        F.ceil(F.col("total") - F.col("top.weight")).cast("int").alias("rest"))
             # Sums of shares may come out a little below a whole number, but never at none.
             .withColumn("tall", F.greatest("rest", F.lit(1))).drop("rest"))
    rows = placed.join(sizes, "block")
    ours, salt = F.col("component") == F.col("major"), F.xxhash64("doc_id")

    def tiles(mixed, i, j):
        return F.struct(F.lit(mixed).alias("mixed"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    tall, wide = F.sequence(F.lit(0), F.col("tall") - 1), F.sequence(F.lit(0), F.col("wide") - 1)
    spot = F.pmod(salt, F.col("tall"))
    where = F.when(ours, F.transform(tall, lambda j: tiles(True, F.pmod(salt, F.col("wide")), j))).otherwise(
        F.concat(F.transform(wide, lambda i: tiles(True, i, spot)),
                 F.transform(tall, lambda j: tiles(False, F.least(spot, j), F.greatest(spot, j)))))
    tiled = rows.select("block", "doc_id", "component", ours.alias("ours"), F.explode(where).alias("tile")).select(
        "block", "tile.*", "doc_id", "component", "ours")

    key = ["block", "mixed", "i", "j"]
    row = [*key, "doc_id", "component", "ours", "counts"]

    def by_tile(handle):
        """Gives ``handle`` the rows of whole tiles, which come in order, and where tiles begin."""
        def run(batches):
            held = None
            for batch in batches:
                rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables(
                    [held, pa.Table.from_batches([batch])])
                tile = [rows.column(c).to_numpy() for c in key]
                edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in tile])) + 1
                edges = [0, *edges.tolist()]
                # The last tile may go on in the next batch.
                yield from handle(rows.slice(0, edges[-1]), edges)
                held = rows.slice(edges[-1])
            if held is not None:
                yield from handle(held, [0, len(held)])
        return run

    def tiles_of(rows, edges):
        parts, ours, mixed = (rows.column(c).to_numpy() for c in ("component", "ours", "mixed"))
        counts = [np.frombuffer(c, np.uint16) for c in rows.column("counts").to_pylist()]
        sizes = rows.column("n").to_numpy()
        for low, high in zip(edges, edges[1:], strict=False):
            if high - low > 1 and (parts[low:high] != parts[low]).any():
                yield low, high, counts[low:high], sizes[low:high], parts[low:high], (
                    ours[low:high] if mixed[low] else None)

    def hopeful(rows, edges):
        keep = np.zeros(len(rows), bool)
        for low, high, counts, sizes, parts, ours in tiles_of(rows, edges):
            for i, near, _ in _near(counts, sizes, parts, ours, rule):
                keep[low + i] = True
                keep[low + near] = True
        yield from rows.filter(pa.array(keep)).to_batches()

    def links(rows, edges):
        ids = rows.column("doc_id").to_numpy()
        tokens = [np.frombuffer(c.as_buffer(), np.uint64) for c in rows.column("tokens")]
        found = [np.zeros((0, 2), np.int64)]
        for low, high, *tile in tiles_of(rows, edges):
            found.append(ids[low:high][_links(tokens[low:high], *tile, rule)])
        found = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    # The points alone tell which members need their whole sets in a tile.
    points = tiled.join(sets.select("doc_id", "counts", "n"), "doc_id").select(*row, "n")
    asked = points.repartition(*key).sortWithinPartitions(*key).mapInArrow(lean(by_tile(hopeful)), points.schema)
    return (asked.join(sets.select("doc_id", "tokens", "n"), ["doc_id", "n"]).select(*row, "n", "tokens")
            .repartition(*key).sortWithinPartitions(*key).mapInArrow(lean(by_tile(links)), "a long, b long").distinct())


def _near(counts, sizes, parts, ours, rule: Rule):
    """(row, rows, bounds) of a tile: what the tree cannot tell from a link, in other components.

    With ``ours`` the rows it marks are held and the others ask, else all rows ask those before.
    """
    groups = min(map(len, counts))
    points = np.array([coarsened(c, groups) for c in counts])
    held = np.flatnonzero(ours) if ours is not None else np.arange(len(counts))
    asking = np.flatnonzero(~ours) if ours is not None else held
    tree = CountTree(points[held], sizes[held])
    for i in asking.tolist():
        near = held[tree.survivors(points[i], sizes[i], rule)]
        near = near[(parts[near] != parts[i]) & ((near < i) | (ours is not None))]
        if len(near):
            yield i, near, np.minimum(points[near], points[i]).sum(1) / (sizes[near] + sizes[i])


def _links(tokens, counts, sizes, parts, ours, rule: Rule) -> np.ndarray:
    """Links of a tile as pairs of row numbers: as many as unite components."""
    label = np.unique(parts, return_inverse=True)[1]
    out = []
    for i, near, bound in _near(counts, sizes, parts, ours, rule):
        # The most alike first: what it unites needs no look at others of that component.
        for j in near[np.argsort(-bound, kind="stable")].tolist():
            if label[i] != label[j] and _shared(tokens[i], tokens[j]) >= rule.shared(sizes[i], sizes[j]):
                label[label == label[j]] = label[i]
                out.append((j, i))
    return np.array(out, np.int64).reshape(-1, 2)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    place = np.searchsorted(y, x)
    return int((y[np.minimum(place, len(y) - 1)] == x).sum())


def link(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """(doc_id, n_shingles, component_id) of every row.

    ``n_shingles`` is the size of the row's set of distinct shingles, 0 for a null text or one
    without words; ``component_id`` is the smallest doc_id that links reach, its own included. Empty
    sets link with nothing. Rows that share a doc_id are one node: what one links, all have. Rows
    without a doc_id have no component and link with nothing. Other columns are left out; an empty
    table gives an empty one. Shingles are told apart by 64-bit hashes, equal sets by 128 bits.
    """
    prepare(documents.sparkSession, BATCH)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    usable = documents.where("doc_id is not null and text is not null")
    sets = store(_sets(documents, rule), "sets")
    full = sets.where("n > 0 and doc_id is not null")
    # Equal sets are one: links go from their smallest doc_id.
    first = full.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = store(full.join(first, "digest").select("doc_id", "first").distinct(), "copies")
    met = store(_blocks(_marks(usable, rule)), "met")
    # Copies that several tasks named are one member.
    named = copies.groupBy("doc_id").agg(F.min("first").alias("first"), F.count("*").alias("sets"))
    firsts = named.where("sets = 1 and doc_id <> first").select("doc_id", "first")
    members = met.where("doc_id is not null").join(firsts, "doc_id", "left").select(
        "block", F.coalesce("first", "doc_id").alias("doc_id")).distinct()
    # Several sets of one node leave no block.
    rests = full.groupBy("doc_id").agg(*(F.when(F.min("digest") == F.max("digest"), F.min(c)).alias(c) for c in ("even", "odd")))
    blocks = _rare(members, met.where("doc_id is null").groupBy("block").agg(F.sum("marks").alias("marks")), rests)
    discard(met)
    tidy(documents.sparkSession)
    stars = store(blocks.where("leader <> doc_id").select(
        F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    chosen = store(blocks.select("doc_id").distinct(), "chosen")
    # Several rows with one doc_id are several sets of one node.
    tokens = store(_tokens(usable.join(hinted(chosen, F.lit(8)), "doc_id"), rule)
                   .withColumn("n", (F.octet_length("tokens") / 8).cast("long")).where("n > 0"), "tokens")
    discard(chosen)
    linked = store(_verified(stars, tokens, rule).distinct(), "linked")
    parts, clusters = components(linked), components(stars)
    discard(stars, linked)
    tidy(documents.sparkSession)
    placed = parts.toDF("doc_id", "component")
    searched = _searched(blocks, clusters.toDF("doc_id", "cluster"), placed, tokens, rule)
    crossed = _across(searched, placed, tokens, rule)
    # Components of what the leaders linked stand for their links.
    edges = store(parts.where("id <> component").union(crossed).union(copies.where("doc_id <> first")).distinct(), "edges")
    discard(parts, clusters, blocks, searched, tokens, copies)
    tidy(documents.sparkSession)
    whole = components(edges)
    discard(edges)
    return sets.join(whole.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
