"""Exact top-k inner products on a bit-sliced index.

The index keeps, for each block of rows, one bitmap per attribute and bit. A query adds the slices
it needs with bitmap arithmetic (full adders over words of 64 rows), which gives the bits of all
scores at once; the k-th best is found from the most significant slice downward. The lowest
``dropped`` bits of each attribute are not sliced: they move a score by a known range, and the rows
within that range of the k-th best are resolved with the whole values.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelake.llm.common import prepare, store
from changelake.llm.vectors import usable

BLOCK = 8192
QUERIES = 128
TILE = 32
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def slices(values: np.ndarray, dropped: int):
    """(lowest shifted value, bitmaps by attribute and bit) of an integer matrix."""
    high = values >> dropped
    low = int(high.min())
    high = (high - low).astype(np.uint32)
    bits = max(1, int(high.max()).bit_length())
    rows, dims = high.shape
    padded = -(-rows // 64) * 64
    out = np.zeros((dims, bits, padded // 64), np.uint64)
    for b in range(bits):
        plane = np.zeros((dims, padded), np.uint8)
        plane[:, :rows] = ((high >> np.uint32(b)) & 1).T
        out[:, b] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
    return low, out


def add_slices(planes: np.ndarray, queries: np.ndarray):
    """(score slices, constants): sums of |q| * value, or of |q| * complement where q < 0.

    The score of a row on the shifted values is the number in its slices plus the constant.
    """
    dims, bits, words = planes.shape
    size, sign = np.abs(queries), queries < 0
    top = int((size.sum(1).max() * ((1 << bits) - 1))).bit_length() + 1
    sums = np.zeros((top, len(queries), words), np.uint64)
    for d in range(dims):
        negate = np.where(sign[:, d], FULL, np.uint64(0))[:, None]
        for p in range(int(size[:, d].max()).bit_length()):
            chosen = ((size[:, d] >> p) & 1).astype(bool)
            if not chosen.any():
                continue
            mask = np.where(chosen, FULL, np.uint64(0))[:, None]
            carry = np.zeros((len(queries), words), np.uint64)
            for b in range(bits):
                part = (planes[d, b] ^ negate) & mask
                row = sums[p + b]
                either = row ^ part
                part &= row
                part |= carry & either
                row[:] = either ^ carry
                carry = part
            for j in range(p + bits, top):
                row = sums[j]
                both = row & carry
                row ^= carry
                carry = both
                if not carry.any():
                    break
    return sums, -np.where(sign, size, 0).sum(1) * ((1 << bits) - 1)


def kth_largest(sums: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest number under ``valid``, from the most significant slice downward (0 if fewer)."""
    left = np.full(sums.shape[1], k)
    among, value = valid.copy(), np.zeros(sums.shape[1], np.int64)
    enough = np.bitwise_count(valid).sum(1) >= k
    for j in range(len(sums) - 1, -1, -1):
        ones = among & sums[j]
        count = np.bitwise_count(ones).sum(1).astype(np.int64)
        take = count >= left
        among = np.where(take[:, None], ones, among & ~sums[j])
        left = np.where(take, left, left - count)
        value += take.astype(np.int64) << j
    return np.where(enough, value, 0)


def at_least(sums: np.ndarray, valid: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Bitmaps of the rows under ``valid`` whose number is ``bound`` or more."""
    bound = np.maximum(bound, 0)
    above, equal = np.zeros_like(valid), valid.copy()
    equal[(bound >> len(sums)) > 0] = 0
    for j in range(len(sums) - 1, -1, -1):
        one = np.where(((bound >> j) & 1).astype(bool), FULL, np.uint64(0))[:, None]
        above |= equal & sums[j] & ~one
        equal &= ~(sums[j] ^ one)
    return above | equal


def search_block(ids, values, low, planes, query_ids, queries, k, dropped):
    """Each query's k best rows of one block: arrays (query, vec_id, score)."""
    rows = len(ids)
    valid = np.zeros(planes.shape[2] * 64, np.uint8)
    valid[:rows] = 1
    valid = np.packbits(valid, bitorder="little").view(np.uint64)
    found = []
    for start in range(0, len(query_ids), TILE):
        asked, q = query_ids[start:start + TILE], queries[start:start + TILE]
        allowed = np.repeat(valid[None], len(q), 0)
        place = np.searchsorted(ids, asked)  # ids are sorted
        own = (place < rows) & (ids[np.minimum(place, rows - 1)] == asked)
        for i in np.flatnonzero(own):
            allowed[i, place[i] // 64] &= ~(np.uint64(1) << np.uint64(place[i] % 64))
        sums, _ = add_slices(planes, q)
        # The dropped bits add q * r with 0 <= r < 2**dropped: a row can rise by all of its range
        # over one that sinks by all of its own.
        play = -(-np.abs(q).sum(1) * ((1 << dropped) - 1) >> dropped)
        picked = at_least(sums, allowed, kth_largest(sums, allowed, k) - play)
        for i in range(len(q)):
            near = np.flatnonzero(np.unpackbits(picked[i].view(np.uint8), bitorder="little"))
            scores = values[near].astype(np.int64) @ q[i]
            best = np.lexsort((ids[near], -scores))[:k]
            found.append((np.full(len(best), asked[i]), ids[near][best], scores[best]))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, dropped: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Attributes are floor(scale * x); queries are the rows whose vec_id is divisible by ``every``,
    candidates every row but the query's own; ties go to the smaller vec_id, fewer candidates give
    fewer rows. See ``usable`` for the rows that take no part; other columns are left out. An empty
    table gives an empty one. Row blocks hold about 8192 rows and meet the queries in packs of 128,
    so no task holds more than one of each. Packs go to blocks by a shuffle, never by a broadcast: Spark
    sees a few queries, not how many blocks each of them goes to.
    """
    spark = vectors.sparkSession
    rows = store(usable(vectors, zero=True).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("value")), "quantised")
    asked = F.col("vec_id") % every == 0
    total, queries = rows.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    blocks, packs = max(1, math.ceil(total / BLOCK)), max(1, math.ceil(queries / QUERIES))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        values = np.array(pdf["value"].tolist(), np.int64)
        low, planes = slices(values, dropped)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                             "vals": [values.tobytes()], "low": [low], "bits": [planes.shape[1]],
                             "planes": [planes.tobytes()]})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pack": [pdf["pack"].iloc[0]], "qids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                             "qvals": [np.array(pdf["value"].tolist(), np.int64).tobytes()]})

    def search(batches):
        held, block = None, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids = np.frombuffer(row.ids, np.int64)
                values = np.frombuffer(row.vals, np.int64).reshape(len(ids), -1)
                if row.pack < 0:  # a block, which its packs follow
                    held = ids, values, row.low, np.frombuffer(row.planes, np.uint64).reshape(values.shape[1], row.bits, -1)
                    block = row.block
                if row.pack < 0 or row.block != block:  # no rows have the number of this block
                    continue
                q, v, s = search_block(*held, ids, values, k, dropped)
                yield pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    prepare(spark)
    index = (rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
             .groupBy("block").applyInPandas(build, "block int, ids binary, vals binary, low long, bits int, planes binary"))
    packed = (rows.where(asked).withColumn("pack", F.pmod(F.xxhash64("vec_id"), F.lit(packs)).cast("int"))
              .groupBy("pack").applyInPandas(pack, "pack int, qids binary, qvals binary"))
    # The stated query set meets all rows in blocks: every pack goes to every block. A task gets a block once and
    # its packs after it, a part of them where there are fewer blocks than make enough tasks.
    parts = max(1, min(packs, -(-4 * spark.sparkContext.defaultParallelism // blocks)))
    units = (index.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).alias("pack"),
                          "ids", "vals", "low", "bits", "planes")
             .union(packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.col("pack") % parts, "pack",
                                  "qids", "qvals", F.lit(0).cast("long"), F.lit(0), F.lit(b""))))
    found = (units.repartitionById(blocks * parts, F.col("block") * parts + F.col("part"))
             .sortWithinPartitions("block", "part", "pack").mapInPandas(search, "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
