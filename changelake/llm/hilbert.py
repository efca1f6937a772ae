"""Approximate nearest neighbours on shifted Hilbert curves of projected vectors.

Each curve projects the vectors on its own random orthonormal directions, shifts the grid and
orders the cells by their Hilbert key. Keys are cut into ranges of equal depth; a query meets the
rows in the ranges around its own key on every curve, and what the windows find is merged and
ranked by the exact distance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelake.llm.common import prepare, store
from changelake.llm.vectors import matrix, usable

RANGE_ROWS = 2048
# A window holds this many rows at least and ten times k, or the whole table.
WINDOW_ROWS = 128


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert keys of integer cells (rows, dims), ``bits`` a dimension; dims * bits <= 62."""
    x = [c.astype(np.int64) for c in cells.T]
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the largest cubes to the smallest
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] = x[i] ^ x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | (((x[i] ^ flip) >> b) & 1)
    return key


def curve(seed: int, number: int, size: int, dims: int, bits: int):
    """(directions, grid shift) of one curve."""
    rng = np.random.default_rng([seed, number])
    directions = np.linalg.qr(rng.normal(size=(size, size)))[0][:, :min(dims, size)]
    return directions, rng.uniform(-0.5, 0.5, directions.shape[1]) / (1 << bits)


def _moments(rows: DataFrame):
    """(length, mean, mean square deviation a component) of all vectors."""
    def sums(batches):
        n, s, q = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("embedding"))
                n, s, q = n + len(x), s + x.sum(0), q + float((x * x).sum())
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [s.tolist()], "q": [q]})

    parts = rows.select("embedding").mapInArrow(sums, "n long, s array<double>, q double")
    each = parts.select("n", "q", F.posexplode("s").alias("place", "s")).groupBy("place").agg(
        F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("s").alias("s")).orderBy("place").collect()
    if not each:
        return 0, np.zeros(0), 1.0
    mean = np.array([r["s"] / r["n"] for r in each])
    spread = each[0]["q"] / each[0]["n"] / len(each) - float((mean * mean).mean())
    return len(each), mean, math.sqrt(max(spread, 1e-30))


def _windows(depths: np.ndarray, reach: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last range) of the window around each range; ``depths`` are the rows in each."""
    ranges, below = len(depths), np.concatenate([[0], np.cumsum(depths)])
    # At an end of the curve the window keeps its width.
    begin = np.maximum(0, np.minimum(np.arange(ranges) - reach, ranges - 1 - 2 * reach))

    def opened(more):
        return np.maximum(begin - more, 0), np.minimum(begin + 2 * reach + more, ranges - 1)

    # The fewest ranges more at both sides that hold enough rows.
    low, high = np.zeros(ranges, np.int64), np.full(ranges, ranges)
    while (low < high).any():
        middle = (low + high) // 2
        first, last = opened(middle)
        enough = below[last + 1] - below[first] >= least
        low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
    return opened(low)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, curves: int = 8, dims: int = 8, bits: int = 7,
            share: float = 0.2, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by Euclidean distance.

    Queries are the rows whose vec_id is divisible by ``every``, candidates every row but the
    query's own; ties go to the smaller vec_id, fewer candidates give fewer rows. See ``usable`` for
    the rows that take no part; other columns are left out. An empty table gives an empty one.
    ``share`` is the part of all rows that a window covers on a curve: nearly isotropic vectors have
    no order that keeps neighbours close, so recall is bought with wide windows. One that holds fewer
    than 128 rows or ten times k opens to both sides until it holds as many; smaller tables are searched
    whole. A range that equal keys make larger than two ranges is split by a salt, and its queries go to
    every piece.
    """
    prepare(vectors.sparkSession)
    rows = store(usable(vectors, zero=False), "vectors")
    size, mean, spread = _moments(rows)
    total = rows.count()
    ranges = max(math.ceil(2 / share) * 2 + 5, math.ceil(total / RANGE_ROWS))
    reach = max(1, math.ceil((share * ranges - 1) / 2))

    def keyed(batches):
        for batch in batches:
            x = matrix(batch.column("embedding"))
            keys = []
            for c in range(curves):
                directions, shift = curve(seed, c, size, dims, bits)
                unit = ((x - mean) @ directions) / spread / 6 + 0.5 + shift
                keys.append(hilbert_keys((np.clip(unit, 0, 1 - 1e-9) * (1 << bits)).astype(np.int64), bits))
            keys = np.stack(keys, 1) if len(x) else np.zeros((0, curves), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), curves)
                 .cast(pa.list_(pa.int64()))], ["vec_id", "keys"])

    keys = store(rows.mapInArrow(keyed, "vec_id long, keys array<long>"), "keys")
    # Range bounds of each curve: a fixed number of quantiles.
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = keys.agg(*(F.percentile_approx(F.col("keys")[c], cuts, 100 * ranges).alias(f"c{c}")
                        for c in range(curves))).first()
    tables = [np.array(bounds[c] if bounds[c] is not None else [], np.int64) for c in range(curves)]

    def placed(batches):
        for batch in batches:
            k = matrix(batch.column("keys")) if batch.num_rows else np.zeros((0, curves), np.int64)
            place = np.stack([np.searchsorted(tables[c], k[:, c]) for c in range(curves)], 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.FixedSizeListArray.from_arrays(pa.array(place.ravel()), curves)
                 .cast(pa.list_(pa.int32()))], ["vec_id", "places"])

    places = store(keys.mapInArrow(placed, "vec_id long, places array<int>")
                   .select("vec_id", F.posexplode("places").alias("curve", "place")), "places")
    pieces = places.groupBy("curve", "place").agg(
        F.ceil(F.count("*") / (2 * RANGE_ROWS)).cast("int").alias("pieces"))
    salted = places.join(pieces, ["curve", "place"]).select(
        "vec_id", "curve", "place", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int").alias("piece"))
    asked = F.col("vec_id") % every == 0
    depths = np.zeros((curves, ranges), np.int64)
    for c, place, depth in places.groupBy("curve", "place").count().collect():
        depths[c, place] = depth
    spans = np.array([_windows(d, reach, min(total, max(WINDOW_ROWS, 10 * k))) for d in depths], np.int32)

    def opened(batches):
        for batch in batches:
            begin, end = spans[batch.column("curve").to_numpy(), :, batch.column("place").to_numpy()].reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("curve"), pa.array(begin), pa.array(end)],
                                             ["vec_id", "curve", "begin", "end"])

    windows = places.where(asked).mapInArrow(opened, "vec_id long, curve int, begin int, end int").select(
        "vec_id", "curve", F.explode(F.sequence("begin", "end")).alias("place"))
    windows = windows.join(pieces, ["curve", "place"]).select(
        "vec_id", "curve", "place", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).join(
        rows.where(asked), "vec_id").toDF("query_id", "q_curve", "q_place", "q_piece", "query")

    def near(key, row_pdf: pd.DataFrame, query_pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(row_pdf) and len(query_pdf):
            ids, x = row_pdf["vec_id"].to_numpy(), matrix(row_pdf["embedding"])
            square = (x * x).sum(1)
            for start in range(0, len(query_pdf), 256):
                part = query_pdf.iloc[start:start + 256]
                asked_ids, q = part["query_id"].to_numpy(), matrix(part["query"])
                rough = square + (q * q).sum(1)[:, None] - 2 * (q @ x.T)
                rough[asked_ids[:, None] == ids] = np.inf
                slack = 1e-9 * (square.max() + (q * q).sum(1).max())
                limit = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1] + slack
                for i, (query, bound) in enumerate(zip(asked_ids, limit, strict=True)):
                    picked = np.flatnonzero((rough[i] <= bound) & (ids != query))
                    exact = np.sqrt(((x[picked] - q[i]) ** 2).sum(1))
                    best = np.lexsort((ids[picked], exact))[:k]
                    found.append(pd.DataFrame({"query_id": query, "vec_id": ids[picked][best], "score": exact[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = (salted.join(rows, "vec_id").groupBy("curve", "place", "piece")
             .cogroup(windows.groupBy("q_curve", "q_place", "q_piece"))
             .applyInPandas(near, "query_id long, vec_id long, score double"))
    # One vector found on several curves is one candidate.
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
