"""How far the sources of a language differ: smoothed term shares compared between sources.

For each language a ``CountVectorizer`` keeps the terms that are in at least ``min_docs`` of its
documents, all of them, and turns what each task has counted of a source into sparse vectors, one for each
binary digit of the counts. Weighted by the place of the digit, the vectors' cells are summed to one sparse
vector for each source. Tasks count first, so that a term in many documents comes as few strings: as many
as tell whether ``min_docs`` documents have it, and the digits of how often each source does. With ``V``
kept terms and ``N`` kept occurrences, a term that occurs ``count`` times has the share
``p = 1 + floor(scale * (count + 5) / (N + 5 V))``; terms that do not occur share one value, so
distances need only what occurs:

    D(a, b) = V |a0 - b0|  +  terms of a against b0  +  terms of b against a0  +  correction for
              terms of both

The first three come from each source's histogram of shares; the last from blocks of terms, each a
task of its own with at most ``BLOCK`` terms. All of it is whole numbers.

The vocabulary of a language goes through the driver, as ``CountVectorizer`` builds it there; it
grows with the terms in ``min_docs`` documents, not with the text. Documents, vectors and sums never
do. A source of any size is summed before the shuffle.

Null text, lang and source are read as empty text; groups without a kept term take part with V
terms that do not occur. A language without kept terms has pairs of value 0 and no terms. Only the
columns text, lang and source are read, so others cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelake.llm.common import blobs, prepare, store, texts, words
from changelake.session import scratch_path

# Bytes that are in no term: all ASCII characters but letters. Of the letters only A-Z change.
BETWEEN = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
LOWER_CASE = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SCALE = 1_000_000_000
ALL_TERMS = 2**31 - 1
# Terms of one block of the pair sums.
BLOCK = 512
# Bytes of text that one step works on; a longer text is one step of its own.
TOGETHER = 1 << 22
# Counted terms that a task holds before it gives them, and most terms of a row.
TERMS_HELD, ROW = 1_000_000, 1024
# Cells that a task holds before it sums them.
CELLS_HELD = 4_000_000
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
CELLS = "lang STRING, source STRING, term STRING, number INT, count BIGINT"


def _lists(names: pa.Array, owner: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(owner, terms) of lists of at most ``ROW`` terms, from terms that come by owner."""
    place = np.arange(len(owner))
    run = np.maximum.accumulate(np.where(np.diff(owner, prepend=-1) != 0, place, 0))
    begins = np.flatnonzero((place - run) % ROW == 0)
    bounds = pa.array(np.append(begins, len(owner)).astype(np.int32))
    return owner[begins], pa.ListArray.from_arrays(bounds, names.take(pa.array(codes)))


def _sums(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """The distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    return [keys[starts], *(np.add.reduceat(c[order], starts) if len(starts) else c for c in counts)]


def _tokenized(min_docs: int):
    """A function that gives the terms of texts, counted over the many texts that a task holds at a time.

    Rows that are ``whole`` tell in how many texts of a language a term is: the first has every term, the
    next those in two texts at least, and so on to ``min_docs`` rows, beyond which it makes no difference.
    The others tell how often each source has a term, by binary digits: it is in those of weight 1, 2, 4,
    ... that add up to its count. Every source has a row at least, if without terms.
    """
    most = max(1, min_docs)

    def cells(column, group):
        """(names, group, code, occurrences, texts) of the terms of some texts."""
        for row, data, offsets in texts(column, TOGETHER):
            count = len(offsets) - 1
            starts, stops, first = words(data, offsets, BETWEEN)
            ends = np.cumsum(stops - starts)
            found = blobs(LOWER_CASE[data[~BETWEEN[data]]], ends).dictionary_encode()
            size, codes = max(1, len(found.dictionary)), found.indices.to_numpy().astype(np.int64)
            keys, repeats = np.unique(np.repeat(np.arange(count), np.diff(first)) * size + codes, return_counts=True)
            keys, times, docs = _sums(group[row + keys // size] * size + keys % size, repeats, np.ones(len(keys), np.int64))
            yield found.dictionary.cast(pa.string()), keys // size, keys % size, times, docs

    def merged(held):
        names = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
        place, size = names.indices.to_numpy().astype(np.int64), max(1, len(names.dictionary))
        edges = np.cumsum([0, *(len(h[0]) for h in held)])
        codes = place[np.concatenate([h[2] + e for h, e in zip(held, edges, strict=False)])]
        group, times, docs = (np.concatenate([h[i] for h in held]) for i in (1, 3, 4))
        keys, times, docs = _sums(group * size + codes, times, docs)
        return names.dictionary, keys // size, keys % size, times, docs

    def given(held, known, langs):
        if not held:
            return
        names, group, codes, times, docs = merged(held)
        of = pa.array([g[0] for g in known], pa.string()), pa.array([g[1] for g in known], pa.string())
        for bit in range(int(times.max(initial=0)).bit_length()):
            chosen = times >> bit & 1 == 1
            owner, terms = _lists(names, group[chosen], codes[chosen])
            yield _rows(*(x.take(pa.array(owner)) for x in of), 1 << bit, False, terms)
        size, number = max(1, len(names)), np.array([langs[g[0]] for g in known], np.int64)
        keys, docs = _sums(number[group] * size + codes, docs)
        by_number = pa.array(list(langs), pa.string())
        for row in range(min(most, int(docs.max(initial=0)))):
            chosen = keys[docs > row]
            owner, terms = _lists(names, chosen // size, chosen % size)
            yield _rows(by_number.take(pa.array(owner)), pa.nulls(len(owner), pa.string()), 0, True, terms)

    def run(batches):
        known, langs, held, size = {}, {}, [], 0
        for batch in batches:
            group = np.array([known.setdefault(g, len(known)) for g in zip(
                batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True)], np.int64)
            for lang, _ in known:
                langs.setdefault(lang, len(langs))
            for found in cells(batch["text"], group):
                held.append(found)
                size += len(found[1])
                if size > TERMS_HELD:
                    yield from given(held, known, langs)
                    held, size = [], 0
        yield from given(held, known, langs)
        names = [pa.array([g[i] for g in known], pa.string()) for i in (0, 1)]
        empty = pa.array([[]] * len(known), pa.list_(pa.string()))
        yield _rows(*names, 1, False, empty)

    return run


def _rows(lang: pa.Array, source: pa.Array, weight: int, whole: bool, terms: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [lang, source, pa.array(np.full(len(terms), weight, np.int64)), pa.array(np.full(len(terms), whole)), terms],
        ["lang", "source", "weight", "whole", "terms"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the cells of sparse vectors by source, a few million cells at a time."""
    def result():
        keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(known)).take(pa.array(keys[starts] >> 32)), pa.array((keys[starts] & 0xFFFFFFFF).astype(np.int32)),
             pa.array(np.add.reduceat(counts, starts))], ["source", "number", "count"])

    known: dict[str, int] = {}
    held, size = [], 0
    for batch in batches:
        vectors = batch["vector"]
        indices, values = vectors.field("indices"), vectors.field("values")
        per_row = np.diff(indices.offsets.to_numpy())
        sources = np.array([known.setdefault(s, len(known)) for s in batch["source"].to_pylist()], np.int64)
        keys = (np.repeat(sources, per_row) << 32) + indices.flatten().to_numpy()
        counts = values.flatten().to_numpy().astype(np.int64) * np.repeat(batch["weight"].to_numpy(), per_row)
        if len(keys):
            held.append((keys, counts))
            size += len(keys)
        if size > CELLS_HELD:
            yield result()
            known, held, size = {}, [], 0
    if held:
        yield result()


def _vectors(tokens: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Sparse count vectors of the sources of one language, and the kept terms by number."""
    spark = tokens.sparkSession
    model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=ALL_TERMS).fit(
        tokens.where("whole").select("terms"))
    saved = scratch_path(spark, "terms")
    model.save(saved)
    kept = spark.read.parquet(f"{saved}/data").select(F.posexplode("vocabulary").alias("number", "term"))
    return model.transform(tokens.where("not whole and size(terms) > 0")).select("source", "weight", "vector"), kept


def cells(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Stored (lang, source, term, number, count) of every kept term of a source, and (lang, source)
    of every group. One pass over the texts; each language's part is a directory of its own."""
    spark = docs.sparkSession
    prepare(spark)
    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    path = scratch_path(spark, "tokens")
    schema = "lang STRING, source STRING, weight BIGINT, whole BOOLEAN, terms ARRAY<STRING>"
    found = read.mapInArrow(_tokenized(min_docs), schema).withColumn("part", F.md5("lang"))
    # Few languages are written side by side; a task that meets more of them sorts its rows.
    before = spark.conf.get(WRITERS, "0")
    spark.conf.set(WRITERS, "32")
    found.write.partitionBy("part").parquet(path)
    spark.conf.set(WRITERS, before)
    schema += ", part STRING"
    tokens = spark.read.schema(schema).parquet(path)
    groups = store(tokens.where("not whole").select("lang", "source").distinct(), "groups")
    out = scratch_path(spark, "cells")
    spark.createDataFrame([], CELLS).write.parquet(out)
    for row in groups.select("lang", F.md5("lang").alias("part")).distinct().orderBy("lang").collect():
        vectors, kept = _vectors(tokens.where(F.col("part") == row["part"]), min_docs)
        counts = (vectors.mapInArrow(_summed, "source STRING, number INT, count BIGINT")
                  .groupBy("source", "number").agg(F.sum("count").alias("count")))
        counts.join(kept, "number").select(
            F.lit(row["lang"]).alias("lang"), "source", "term", "number", "count").write.mode("append").parquet(out)
    return spark.read.schema(CELLS).parquet(out), groups


def share(count: Column, total: Column, n_terms: Column) -> Column:
    """``1 + floor(SCALE (count + 5) / (total + 5 n_terms))``, exactly."""
    wide = "decimal(38,0)"
    over = (F.lit(SCALE).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)")).cast(wide)
    return F.call_function("div", over, (total + n_terms * 5).cast(wide)) + 1


def pair_corrections(frame: pd.DataFrame) -> pd.DataFrame:
    """For each pair of sources, over the block's terms that both have: the distance of the shares,
    and back out what each has against the other's ``zero`` share."""
    sources, row = np.unique(frame["source"].to_numpy(), return_inverse=True)
    _, column = np.unique(frame["number"].to_numpy(), return_inverse=True)
    p = np.zeros((len(sources), column.max() + 1), np.int64)
    p[row, column] = frame["p"].to_numpy()
    zero = np.zeros(len(sources), np.int64)
    zero[row] = frame["zero"].to_numpy()
    found = []
    for i in range(len(sources) - 1):
        mine = np.flatnonzero(p[i])
        a, a0 = p[i, mine], zero[i]
        b, b0 = p[i + 1:, mine], zero[i + 1:, None]
        both = (np.abs(a - b) - np.abs(a - b0) - np.abs(a0 - b) + np.abs(a0 - b0)) * (b > 0)
        some = np.flatnonzero((b > 0).any(axis=1))
        found.append((np.full(len(some), i), some + i + 1, both.sum(axis=1)[some]))
    if not found:
        return pd.DataFrame({"lang": [], "a": [], "b": [], "value": []}, dtype=object)
    i, j, value = map(np.concatenate, zip(*found, strict=True))
    return pd.DataFrame({"lang": frame["lang"].iloc[0], "a": sources[i], "b": sources[j], "value": value})


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""
    histogram = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    side = groups.join(histogram.groupBy("lang", "source").agg(
        F.collect_list(F.struct("p", "n")).alias("histogram")), ["lang", "source"], "left").select(
        "lang", "source", "zero", "n_terms", F.coalesce("histogram", F.array().cast(
            "array<struct<p: bigint, n: bigint>>")).alias("histogram"))
    side = store(side, "histograms")

    def against(histogram: Column, own: Column, other: Column) -> Column:
        start = F.lit(0).cast("long")
        return F.aggregate(histogram, start, lambda total, h: total + h["n"] * (
            F.abs(h["p"] - other) - F.abs(own - other)))

    one, two = side.alias("x"), side.alias("y")
    both = one.join(two, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.source") < F.col("y.source")))
    plain = both.select(F.col("x.lang").alias("lang"), F.col("x.source").alias("a"), F.col("y.source").alias("b"), (
        F.coalesce(F.col("x.n_terms") * F.abs(F.col("x.zero") - F.col("y.zero")), F.lit(0))
        + against(F.col("x.histogram"), F.col("x.zero"), F.col("y.zero"))
        + against(F.col("y.histogram"), F.col("y.zero"), F.col("x.zero"))).alias("value"))
    block = F.expr(f"number div {BLOCK}")
    common = shares.withColumn("block", block).groupBy("lang", "block").applyInPandas(
        pair_corrections, "lang STRING, a STRING, b STRING, value BIGINT")
    value = plain.unionByName(common).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return value.select("lang", ends.alias("ends"), "value").select("lang", "ends.*", "value")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language by distance (part
    ``pair``), and the ``top`` terms that the source uses more than its language does (``term``)."""
    counts, groups = cells(docs, min_docs)
    whole = counts.groupBy("lang", "number").agg(F.sum("count").alias("whole"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    langs = whole.groupBy("lang").agg(F.sum("whole").alias("lang_total"), F.count(F.lit(1)).alias("n_terms"))
    zero = F.when(F.col("n_terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("n_terms")))
    groups = store(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(
        0, ["total", "lang_total", "n_terms"]).withColumn("zero", zero), "totals")
    shares = store(counts.join(groups, ["lang", "source"]).withColumn(
        "p", share(F.col("count"), F.col("total"), F.col("n_terms"))), "shares")
    q = share(F.col("whole"), F.col("lang_total"), F.col("n_terms"))
    own = shares.join(whole, ["lang", "number"]).withColumn("q", q).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    first = own.withColumn("rank", rank).where(F.col("rank") <= top)
    pairs = _pairs(shares.select("lang", "source", "number", "p", "zero"), groups)
    ranked = pairs.withColumn("rank", rank).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return ranked.unionByName(first)
