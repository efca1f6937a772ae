"""Repeated byte strings of a fixed length, with a logarithmic family of sparse suffix arrays.

Every string of ``length`` bytes has one minimiser: the position of its smallest hashed k-gram. It
depends on the string alone, so equal strings have it at the same place. A batch's suffix array
holds the suffixes that start at minimisers, in the order of the fingerprint of their first k bytes
(equality is all that a scan for matches asks for). A new batch is merge-scanned against the levels
that exist; levels of equal size merge, so there are never more than the logarithm of the number of
batches. Suffixes that match are then compared as far as the length asks for: first for sixteen
strings at a time, by what all of them hold and what they cover together, then string by string
where these disagree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelake.llm.common import blobs, hinted, prepare, span_hash, store, texts

GRAM = 64
GROUP = 16
# A longer text is read in parts that overlap by length - 1 bytes; positions in a part have 24 bits.
PART = 1 << 22
PLACE_BITS = np.uint64(24)
BATCHES = 4


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, in three passes."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:count], before[width - 1:width - 1 + count])


def minimisers(data: np.ndarray, offsets: np.ndarray, length: int):
    """Arrays (position, fingerprint, first string, last string): strings by their minimiser.

    Positions are in ``data``; strings are numbered by where they start and never cross texts.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.view(np.uint64), none, none
    hashing = span_hash(1010)
    sums, grams = hashing.sums(data), np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    prints = hashing.windows(sums, GRAM)
    # Smallest fingerprint (its upper 40 bits), leftmost place among equals.
    ranked = prints >> PLACE_BITS
    ranked <<= PLACE_BITS
    ranked |= grams
    best = sliding_min(ranked, length - GRAM + 1)
    best &= np.uint64((1 << 24) - 1)
    best = best.view(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    lengths = np.diff(offsets)
    long = lengths >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:len(best)]) > 0)
    if not len(starts):
        return none, none.view(np.uint64), none, none
    at = best[starts]
    change = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate([[0], change]), np.concatenate([change - 1, [len(at) - 1]])
    return at[first], prints[at[first]], starts[first], starts[last]


def parts(column: pa.Array, length: int):
    """(first row, bytes, offsets, byte at which the part starts in its text)."""
    for row, data, offsets in texts(column):
        if len(data) <= PART:
            yield row, data, offsets, 0
        else:  # one long text
            for start in range(0, max(1, len(data) - length + 1), PART):
                part = data[start:start + PART + length - 1]
                yield row, part, np.array([0, len(part)]), start


def _ids(documents: DataFrame) -> DataFrame:
    """Texts long enough, by content: equal texts are one (its copies are removed as a whole)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.unhex(F.md5(text)).alias("t"), text.alias("text"))


class _Seen:
    """Texts that a task has met, as far as a bounded set can say: copies need no second look."""

    def __init__(self, limit: int = 200_000):
        self.ids: set[bytes] = set()
        self.limit = limit

    def fresh(self, ids: list[bytes]) -> np.ndarray:
        out = []
        for x in ids:
            out.append(x not in self.ids)
            self.ids.add(x)
        if len(self.ids) > self.limit:
            self.ids.clear()
        return np.array(out, bool)


def suffixes(documents: DataFrame, length: int) -> DataFrame:
    """(key, t, at): the suffixes at minimisers, by the fingerprint of their first bytes."""
    def run(batches):
        seen = _Seen()
        for batch in batches:
            batch = batch.filter(pa.array(seen.fresh(batch.column("t").to_pylist())))
            for row, data, offsets, base in parts(batch.column("text"), length):
                at, key, _, _ = minimisers(data, offsets, length)
                if len(at):
                    owner = np.searchsorted(offsets, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), batch.column("t").take(pa.array(owner + row)),
                         pa.array(at - offsets[owner] + base)], ["key", "t", "at"])

    return (_ids(documents).where(F.octet_length("text") >= length)
            .mapInArrow(run, "key long, t binary, at long"))


class IndexFamily:
    """Sorted levels of suffix fingerprints, whose sizes double."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes (key, place) of a new batch; gives the keys that it shares with a level or repeats."""
        # Levels of equal size merge before a new one comes.
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, newer), (_, older) = self.levels.pop(), self.levels.pop()
            both = newer.union(older).groupBy("key").agg(F.min("first").alias("first"), F.max("last").alias("last"))
            self.levels.append((rank + 1, store(both.sortWithinPartitions("key"), "level")))
        level = store(batch.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last"))
                      .sortWithinPartitions("key"), "level")
        found = level.where("first <> last").select("key")
        for _, older in self.levels:
            found = found.union(level.join(older.hint("merge"), "key").select("key"))
        self.levels.append((0, level))
        return found.distinct()


def _grouped(documents: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """(whole, core, t, first, last): up to sixteen strings around a matched minimiser.

    ``core`` hashes the bytes that all of them hold, ``whole`` those that they cover together; where
    these reach beyond the text, ``whole`` is a hash that nothing else has.
    """
    def run(batches):
        hashing, seen = span_hash(1011), _Seen()
        for batch in batches:
            batch = batch.filter(pa.array(seen.fresh(batch.column("t").to_pylist())))
            wanted = batch.column("ats")
            for row, data, offsets, base in parts(batch.column("text"), length):
                at, _, first, last = minimisers(data, offsets, length)
                if not len(at):
                    continue
                owner = np.searchsorted(offsets, at, "right") - 1
                low = offsets[owner]
                keep = np.zeros(len(at), bool)
                edges = np.searchsorted(owner, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    own = slice(edges[i], edges[i + 1])
                    if own.start < own.stop:
                        keep[own] = np.isin(at[own] - low[own] + base, np.asarray(wanted[row + i].values))
                at, first, last, owner = at[keep], first[keep], last[keep], owner[keep]
                # Groups lie at fixed distances before the minimiser.
                near, far = (at - last) // GROUP, (at - first) // GROUP
                count = far - near + 1
                pick = np.repeat(np.arange(len(at)), count)
                group = near[pick] + np.arange(len(pick)) - np.repeat(np.cumsum(count) - count, count)
                head = at[pick] - GROUP * group  # the last string of a whole group starts here
                sums = hashing.sums(data)
                core = hashing.spans(sums, head, head - GROUP + 1 + length)
                low, high = offsets[owner[pick]], offsets[owner[pick] + 1]
                fits = (head - GROUP + 1 >= low) & (head + length <= high)
                # A group that lies in the text is taken whole, also where its strings have another
                # minimiser: any group of the same cover can then stand for it.
                begin = np.where(fits, head - GROUP + 1, np.maximum(first[pick], head - GROUP + 1))
                end = np.where(fits, head, np.minimum(last[pick], head))
                whole = np.zeros(len(pick), np.uint64)
                whole[fits] = hashing.spans(sums, head[fits] - GROUP + 1, head[fits] + length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(whole.view(np.int64), mask=~fits), pa.array(core.view(np.int64)),
                    batch.column("t").take(pa.array(owner[pick] + row)),
                    pa.array(begin - low + base), pa.array(end - low + base)],
                    ["whole", "core", "t", "first", "last"])

    rows = _ids(documents).join(chosen, "t").mapInArrow(
        run, "whole long, core long, t binary, first long, last long")
    place = F.xxhash64("t", "first")
    return rows.select(F.coalesce("whole", F.xxhash64("t", "first", F.lit("edge"))).alias("whole"), "core", "t",
                       "first", "last", place.alias("place"))


def _strings(documents: DataFrame, open_groups: DataFrame, length: int) -> DataFrame:
    """(print, t, start) of each string of the groups that are still open."""
    def run(batches):
        hashing, seen = span_hash(1012), _Seen()
        for batch in batches:
            batch = batch.filter(pa.array(seen.fresh(batch.column("t").to_pylist())))
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                spans = batch.column("groups")[i].as_py()
                starts = np.unique(np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans]))
                hashes = hashing.spans(hashing.sums(data), starts, starts + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array([batch.column("t")[i].as_py()] * len(starts), pa.binary()),
                     pa.array(starts)], ["print", "t", "start"])

    return _ids(documents).join(open_groups, "t").mapInArrow(run, "print long, t binary, start long")


def repeated_starts(documents: DataFrame, length: int = 400, batches: int = BATCHES) -> DataFrame:
    """(t, starts): ranges (first, last) of starts of strings that also start elsewhere, by text."""
    prepare(documents.sparkSession)
    index = store(suffixes(documents, length), "suffixes")
    family, shared = IndexFamily(), None
    batch = F.pmod(F.xxhash64("t"), F.lit(batches))
    for number in range(batches):
        found = family.add(index.where(batch == number).select("key", F.xxhash64("t", "at").alias("place")))
        shared = found if shared is None else shared.union(found)
    chosen = store(index.join(shared.distinct(), "key").groupBy("t").agg(F.collect_set("at").alias("ats")), "chosen")
    groups = _grouped(documents, hinted(chosen, F.size("ats") * 8 + 16), length)
    # A group whose cover is elsewhere too is decided. If what its strings have in common is
    # elsewhere, but not the cover, they are looked at one by one, against one group of each cover.
    whole, core = Window.partitionBy("whole"), Window.partitionBy("core")
    judged = store(
        groups.withColumn("low", F.min("place").over(whole))
        .withColumn("settled", F.col("low") != F.max("place").over(whole))
        .withColumns({"common": F.min("place").over(core) != F.max("place").over(core),
                      "open": F.max(~F.col("settled")).over(core)})
        .where("common").select(
            "t", "first", "last", "settled",
            (F.col("open") & (~F.col("settled") | (F.col("place") == F.col("low")))).alias("look")), "groups")
    span = F.struct("first", "last")
    open_groups = store(judged.where("look").groupBy("t").agg(F.collect_set(span).alias("groups")), "open")
    strings = _strings(documents, hinted(open_groups, F.size("groups") * 24 + 16), length)
    by_print = Window.partitionBy("print")
    place = F.xxhash64("t", "start")
    single = (strings.withColumn("twice", F.min(place).over(by_print) != F.max(place).over(by_print))
              .where("twice").select("t", F.col("start").alias("first"), F.col("start").alias("last")))
    return judged.where("settled").select("t", "first", "last").union(single).groupBy("t").agg(
        F.sort_array(F.collect_set(span)).alias("starts"))


def covered(starts, length: int) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of bytes that the strings cover; starts as sorted (first, last)."""
    runs: list[tuple[int, int]] = []
    for first, last in starts:
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], last + length))
        else:
            runs.append((first, last + length))
    return runs


def remove_repeats(documents: DataFrame, length: int = 400, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document.

    Every byte that a string of ``length`` bytes covers which starts anywhere else too, in this or
    another document, is removed; ``kept`` holds the others, as bytes. Texts are whole UTF-8 bytes; a
    null text is empty. Texts shorter than ``length`` stay. Rows that repeat a text of ``length``
    bytes or more lose all of it. Columns other than doc_id and text are left out; an empty table
    gives an empty one. Fingerprints have 64 bits and only decide within groups that share another
    one; equal texts are told by MD5.
    """
    spark = documents.sparkSession
    starts = store(repeated_starts(documents, length, batches), "starts")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("t"))
    copies = store(rows.where(F.octet_length("text") >= length).groupBy("t").count().where("count > 1")
                   .select("t", F.lit(True).alias("copied")), "copies")
    marks = store(copies.join(starts, "t", "full"), "marks")
    marked = rows.join(hinted(marks, F.coalesce(F.size("starts"), F.lit(0)) * 24 + 16), "t", "left")
    size = F.octet_length("text").cast("long")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    untouched = marked.where("copied is null and starts is null").select(
        "doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.encode("text", "UTF-8").alias("kept"))
    gone = marked.where("copied").select(
        "doc_id", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        nothing.alias("kept_sha256"), F.lit(b"").alias("kept"))

    def cut(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                data, kept, last = text.encode(), [], 0
                runs = covered([(s["first"], s["last"]) for s in spans], length)
                for a, b in runs:
                    kept.append(data[last:a])
                    last = b
                kept.append(data[last:])
                rest = b"".join(kept)
                for column, value in zip(columns, (len(data), len(data) - len(rest), len(runs),
                                                   hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    some = marked.where("copied is null and starts is not null").select("doc_id", "text", "starts").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return untouched.union(gone).union(some)
