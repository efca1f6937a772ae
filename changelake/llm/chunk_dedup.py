"""Repeated passages by content-defined chunks.

A gear rolling hash over the last 32 bytes chooses cuts after white space, or between any characters
where these bytes hold none, so that an insertion moves only the chunks around it. Chunks are compared by digest; runs of adjacent repeated chunks grow bytewise to both sides against
the place that has them first, and leave every document but that one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.llm.common import STEP, hinted, prepare, span_hash, store, texts, unused

GEAR = np.random.default_rng(2024).integers(0, 2**32, 256, dtype=np.uint32)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LEAST, MOST = 24, 1024
WINDOW = 32
# Bytes at both sides of a repeated run that are compared first.
REACH = 256
SEED = ["key", "start", "stop", "origin", "shift"]


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: sum of table values, shifted once for each byte of distance.

    32 bits forget a byte after 32 steps, so five doublings give what the byte-by-byte form gives.
    """
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        later = h[shift:] + (h[:-shift] << np.uint32(shift))
        h[shift:] = later
    return h


def cuts(data: np.ndarray, offsets: np.ndarray, rare: int = 2, rarer: int = 4) -> np.ndarray:
    """Chunk ends, each text's end among them (none for an empty text).

    A cut needs 24 bytes since the last one and either white space and ``rare`` zero bits at the top
    of the hash, or 32 bytes without white space, the start of a character and ``rarer`` zero bits.
    After 1,024 bytes without a cut the next start of a character is cut.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    # The hash starts anew with each text: bytes of the text before it are taken out of reach by
    # cutting texts apart first.
    space, hashes, first_byte = SPACE[data], gear(data), (data & 0xC0) != 0x80
    found = space & (hashes >> np.uint32(32 - rare) == 0)
    anywhere = np.flatnonzero((hashes >> np.uint32(32 - rarer) == 0) & ~space) + 1
    anywhere = anywhere[(anywhere == len(data)) | first_byte[np.minimum(anywhere, len(data) - 1)]]
    spaces = np.concatenate([[-1], np.flatnonzero(space)])
    found[anywhere[anywhere - 1 - spaces[np.searchsorted(spaces, anywhere) - 1] >= WINDOW] - 1] = True
    found = np.flatnonzero(found) + 1
    starts = offsets[:-1]
    # Near a text's start the window reaches into the text before; such cuts are left out.
    owner = np.searchsorted(starts, found - 1, "right") - 1
    found = found[found - starts[owner] >= WINDOW]
    out: list[int] = []
    candidates, at = found.tolist(), 0
    for start, stop in zip(starts.tolist(), offsets[1:].tolist(), strict=True):
        last = start
        while last < stop:
            while at < len(candidates) and candidates[at] < last + LEAST:
                at += 1
            cut = candidates[at] if at < len(candidates) and candidates[at] < stop else stop
            if cut - last > MOST:
                cut = last + MOST
                while cut < stop and not first_byte[cut]:
                    cut += 1
            out.append(cut)
            last = cut
    return np.array(out, np.int64)


def keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, key, text): the key tells rows apart whose doc_id or text differs."""
    ident = F.col("doc_id").cast("long")
    return documents.select(ident.alias("doc_id"), F.xxhash64(ident, "text").alias("key"), "text")


def chunks(documents: DataFrame) -> DataFrame:
    """(digest, doc_id, key, start, size) of every chunk of every text."""
    def run(batches):
        hashing = span_hash(606)
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key")
            for row, data, offsets in texts(batch.column("text"), STEP):
                ends = cuts(data, offsets)
                if not len(ends):
                    continue
                begins = np.concatenate([[0], ends[:-1]])
                owner = np.searchsorted(offsets, begins, "right") - 1
                rows = pa.array(owner + row)
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashing.spans(hashing.sums(data), begins, ends).view(np.int64)),
                    ids.take(rows), keys.take(rows), pa.array((begins - offsets[owner]).astype(np.int64)),
                    pa.array((ends - begins).astype(np.int32))], ["digest", "doc_id", "key", "start", "size"])

    return documents.mapInArrow(run, "digest long, doc_id long, key long, start long, size int")


def _alike(a: bytes, b: bytes) -> int:
    """The number of first bytes that are the same in both."""
    n = min(len(a), len(b))
    apart = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(apart.argmax()) if apart.any() else n


def _extended(seeds: DataFrame, content: DataFrame, reach: int) -> DataFrame:
    """(key, start, stop, origin, shift, low, high, open): seeds with the bytes at both sides that are the same
    in the place they repeat, whole characters of them; open ones are the same as far as ``reach``."""
    def sides(start, stop, name):
        data = F.col("data")
        begin = F.greatest(start - reach, F.lit(0))
        return [F.substr(data, (begin + 1).cast("int"), (start - begin).cast("int")).alias(f"{name}_before"),
                F.substr(data, (stop + 1).cast("int"), F.lit(reach)).alias(f"{name}_after")]

    def run(batches):
        for batch in batches:
            low, high, more = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("before", "after", "from_before", "from_after"))
            for start, stop, before, after, from_before, from_after in zip(
                    batch.column("start").to_pylist(), batch.column("stop").to_pylist(), *columns, strict=True):
                left, right = _alike(before[::-1], from_before[::-1]), _alike(after, from_after)
                more.append(left == reach or right == reach)
                while left and before[-left] & 0xC0 == 0x80:
                    left -= 1
                while right and right < len(after) and after[right] & 0xC0 == 0x80:
                    right -= 1
                low.append(start - left)
                high.append(stop + right)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in SEED), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                 pa.array(more, pa.bool_())], [*SEED, "low", "high", "open"])

    origin = content.withColumnRenamed("key", "origin")
    moved = [F.col(c) - F.col("shift") for c in ("start", "stop")]
    asked = (seeds.join(origin, "origin").select(*SEED, *sides(*moved, "from"))
             .join(content, "key").select(*SEED, *sides(F.col("start"), F.col("stop"), "own"), "from_before", "from_after")
             .withColumnsRenamed({"own_before": "before", "own_after": "after"}))
    return asked.mapInArrow(run, "key long, start long, stop long, origin long, shift long, low long, high long, "
                                 "open boolean")


def repeated_spans(documents: DataFrame, least: int) -> DataFrame:
    """(key, spans): [start, stop) in bytes of repeated passages after the place that has them first.

    The first place of a digest is the one with the smallest (doc_id, key, start). Adjacent chunks
    that repeat adjacent places are a seed; it grows to both sides as far as the bytes are the same
    there. A passage is a grown seed of ``least`` bytes, or a run of adjacent repeated chunks of
    ``least`` bytes in all; passages may overlap.
    """
    documents = keyed(documents)
    by_digest = Window.partitionBy("digest").orderBy("doc_id", "key", "start")
    later = (chunks(documents)
             .withColumns({"origin": F.first("key").over(by_digest), "s": F.first("start").over(by_digest)})
             .where("doc_id is not null and not (key = origin and start = s)"))
    # A chunk that starts where none ended begins a run; one that repeats another place begins a seed.
    in_order = Window.partitionBy("key").orderBy("start")

    def differs(column, before):
        return F.coalesce(F.lag(before).over(in_order) != F.col(column), F.lit(True))

    # Repeated rows give a chunk twice; it counts once.
    marked = (later.select("key", "start", F.col("size").cast("long").alias("size"), "origin",
                           (F.col("start") - F.col("s")).alias("shift")).dropDuplicates(["key", "start"])
              .withColumn("first", differs("start", F.col("start") + F.col("size")))
              .withColumn("other", F.col("first") | differs("origin", F.col("origin")) | differs("shift", F.col("shift")))
              .withColumns({"run": F.sum(F.col("first").cast("int")).over(in_order),
                            "seed": F.sum(F.col("other").cast("int")).over(in_order)}))
    found = store(marked.groupBy("key", "run", "seed", "origin", "shift").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("stop")), "seeds")
    passages = (found.groupBy("key", "run").agg(F.min("start").alias("low"), F.max("stop").alias("high"))
                .select("key", "low", "high"))
    seeds = found.select(*SEED)
    # The texts that seeds lie in or repeat, each once.
    named = seeds.select("key").union(seeds.select("origin")).distinct()
    content = documents.select("key", F.col("text").cast("binary").alias("data")).join(
        named, "key", "left_semi").dropDuplicates(["key"])
    reach = REACH
    while True:
        grown = store(_extended(seeds, content, reach), "grown")
        passages = passages.union(grown.where("not open").select("key", "low", "high"))
        seeds, reach = grown.where("open").select(*SEED), reach * 16
        if seeds.isEmpty():
            break
    return (passages.where(F.col("high") - F.col("low") >= least).distinct().groupBy("key")
            .agg(F.sort_array(F.collect_list(F.struct(F.col("low").alias("start"), F.col("high").alias("stop"))))
                 .alias("spans")))


def deduplicate(documents: DataFrame, least: int = 100) -> DataFrame:
    """``documents`` with repeated passages taken out of ``text``, and n_bytes, n_removed, n_spans.

    A passage of ``least`` bytes or more that holds a chunk an earlier place has too stays in the
    document with the smallest (doc_id, position) alone, from its first to its last equal byte;
    shorter repeats and all other text stay as they are. Texts are compared as UTF-8 bytes, whole;
    cuts lie between characters. Null and empty texts stay as they are, with 0. Rows that repeat a
    doc_id and its text are one place and keep the same text; other texts of that doc_id are places
    of their own. Texts of rows without a doc_id stay, and come before all others. Other columns
    stay; those that have one of the new names give way.
    """
    prepare(documents.sparkSession)
    base = documents.drop("n_bytes", "n_removed", "n_spans")
    key, found, hit = unused(base, "key", "spans", "hit")
    spans = store(repeated_spans(base, least), "spans")
    spans = hinted(spans, F.size("spans") * 16)
    schema = T.StructType([*base.schema.fields, *(T.StructField(n, T.LongType())
                                                  for n in ("n_bytes", "n_removed", "n_spans"))])
    names = base.columns
    marked = base.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text")).join(
        spans.select(F.col("key").alias(key), F.col("spans").alias(found), F.lit(True).alias(hit)), key, "left")
    touched, clean = marked.where(F.col(hit)), marked.where(F.col(hit).isNull())

    def cut(batches):
        for batch in batches:
            kept, sizes, removed, counts = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(found).to_pylist(), strict=True):
                data, parts, last, gone, n = (text or "").encode(), [], 0, 0, 0
                for span in spans:
                    start, stop = max(span["start"], last), span["stop"]
                    if stop <= last and n:
                        continue
                    # Passages that overlap or touch are one span.
                    n += not (n and start == last)
                    parts.append(data[last:start])
                    gone, last = gone + stop - start, stop
                parts.append(data[last:])
                kept.append(None if text is None else b"".join(parts).decode("utf-8", "ignore"))
                sizes.append(len(data))
                removed.append(gone)
                counts.append(n)
            columns = [pa.array(kept, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(pa.array(c, pa.int64()) for c in (sizes, removed, counts))],
                [*names, "n_bytes", "n_removed", "n_spans"])

    return touched.select(*names, found).mapInArrow(cut, schema).union(clean.select(
        *names, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans")))
