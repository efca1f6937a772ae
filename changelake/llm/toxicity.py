"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy on parts of the texts.

A word's embedding is the sum of hashed embeddings of the whole word and of its first letters, so
that unseen forms of a known stem still count. Filters of several widths run over the words of the
whole text, each filter keeps its largest answer, and a logistic layer turns these into a score.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.llm.common import discard, prepare, span_hash, store, texts, words

# Bytes that end a word: all of ASCII but letters and digits.
ENDS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
STEMS = (3, 4, 5)


@dataclass
class Shape:
    """Sizes of the classifier and bounds of its training; all are parameters."""

    buckets: int = 1 << 18
    size: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 6
    # Training begins on this many labelled texts of each label, none longer than this many
    # characters, and then goes over all others, whole. Scoring reads every text whole.
    sample: int = 2500
    longest_sampled: int = 50_000
    # A hashed feature that fewer labelled texts have is left at zero.
    least_texts: int = 3
    # Steps that training begins with, on 32 texts each.
    steps: int = 640
    # Texts of a part of the labelled ones that is learned from on its own, and most parts.
    part: int = 2000
    most_parts: int = 128
    rate: float = 0.05
    seed: int = 11


@dataclass
class Model:
    shape: Shape
    index: np.ndarray  # bucket to row of ``embed``; row 0 is the unknown one
    embed: np.ndarray
    filters: list[np.ndarray]  # (width, size, filters) each
    biases: list[np.ndarray]
    out: np.ndarray
    shift: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def pooled(self, data: np.ndarray, offsets: np.ndarray, spots: bool = False):
        """The largest answer of every filter in each text (and where); 0 if none is positive."""
        features, first = features_of(data, offsets, self.shape.buckets)
        rows = self.index[features]
        x = self.embed[rows].sum(1)
        answers, where = [], []
        for kernel, bias in zip(self.filters, self.biases, strict=True):
            width = len(kernel)
            z = np.zeros((len(x) + width, kernel.shape[2]), np.float32)
            for j in range(width):
                # Beyond the end of a text stand zeros: its last words have answers too.
                part = x[j:] @ kernel[j]
                if j:
                    own = np.repeat(first[1:], np.diff(first))
                    part[(np.arange(len(part)) + j) >= own[:len(part)]] = 0
                z[:len(part)] += part
            z = z[:len(x)] + bias
            best = np.zeros((len(offsets) - 1, kernel.shape[2]), np.float32)
            full = np.flatnonzero(np.diff(first) > 0)
            if len(full):
                best[full] = np.maximum.reduceat(z, first[full], axis=0)
            if spots:
                where.append([z[a:b].argmax(0) + a if b > a else None for a, b in zip(first, first[1:], strict=False)])
            answers.append(np.maximum(best, 0))
        pooled = np.concatenate(answers, 1)
        return (pooled, where, rows, x, first) if spots else pooled

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        logits = self.pooled(data, offsets).astype(np.float64) @ self.out - self.shift
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def features_of(data: np.ndarray, offsets: np.ndarray, buckets: int):
    """(bucket numbers by word: the word and its stems, first word of each text)."""
    starts, stops, first = words(data, offsets, ENDS)
    hashing = span_hash(101, fold=True)
    sums = hashing.sums(data)
    columns = [hashing.spans(sums, starts, stops)]
    columns += [hashing.spans(sums, starts, np.minimum(starts + n, stops)) ^ np.uint64(n) for n in STEMS]
    return (np.stack(columns, 1) % np.uint64(buckets)).astype(np.int32), first


def _joined(sample: list[str]):
    data = [t.encode() for t in pc.utf8_lower(pa.array(sample, pa.string())).to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return np.frombuffer(b"".join(data), np.uint8), offsets


def untrained(shape: Shape) -> Model:
    """The model of an empty sample: every score is next to 0."""
    return Model(shape, np.zeros(shape.buckets, np.int32), np.zeros((1, shape.size), np.float32),
                 [np.zeros((w, shape.size, shape.filters), np.float32) for w in shape.widths],
                 [np.zeros(shape.filters, np.float32) for _ in shape.widths],
                 np.zeros(len(shape.widths) * shape.filters), 40.0)


def features_in(column: pa.Array, buckets: int) -> np.ndarray:
    """How many of the texts have each hashed feature."""
    seen = np.zeros(buckets, np.int64)
    for _, data, offsets in texts(pc.utf8_lower(column)):
        for start, stop in zip(offsets[:-1], offsets[1:], strict=True):
            seen[np.unique(features_of(data[start:stop], np.array([0, stop - start]), buckets)[0])] += 1
    return seen


def fit(sample: list[str], labels: list[int], shape: Shape) -> Model:
    """Trains on whole texts by Adagrad; a fifth is held back to place the score's middle."""
    if not len(labels):
        return untrained(shape)
    return begin(sample, labels, shape, features_in(pa.array(sample, pa.string()), shape.buckets))[0]


def begin(sample: list[str], labels: list[int], shape: Shape, seen: np.ndarray) -> tuple[Model, dict]:
    """The same, and Adagrad's sums, to go on from; ``seen`` has the number of texts of each feature."""
    rng = np.random.default_rng(shape.seed)
    y = np.array(labels, np.float64)
    data, offsets = _joined(sample)
    # Hashed features that enough texts have get an embedding.
    common = np.flatnonzero(seen >= shape.least_texts)
    index = np.zeros(shape.buckets, np.int32)
    index[common] = np.arange(1, len(common) + 1)
    embed = rng.normal(0, 0.05, (len(common) + 1, shape.size)).astype(np.float32)
    embed[0] = 0
    kernels = [rng.normal(0, 0.5, (w, shape.size, shape.filters)).astype(np.float32) for w in shape.widths]
    biases = [np.zeros(shape.filters, np.float32) for _ in shape.widths]
    out = rng.normal(0.5, 0.1, len(shape.widths) * shape.filters)
    model = Model(shape, index, embed, kernels, biases, out, 1.0)
    order = rng.permutation(len(sample))
    held, learn = order[:len(sample) // 5], order[len(sample) // 5:]
    speed = {"embed": np.full(embed.shape, 1e-6, np.float32), "out": np.full(out.shape, 1e-6), "shift": 1e-6}
    speed |= {("k", i): np.full(k.shape, 1e-6, np.float32) for i, k in enumerate(kernels)}
    speed |= {("b", i): np.full(b.shape, 1e-6, np.float32) for i, b in enumerate(biases)}
    if not len(learn) or y.min() == y.max():
        model.shift = 40.0 if not y.any() else -40.0
        return model, speed
    weight = np.where(y == 1, 0.5 / max(1, y[learn].sum()), 0.5 / max(1, (1 - y[learn]).sum())) * len(learn)
    for _ in range(-(-shape.steps * 32 // len(learn))):
        rng.shuffle(learn)
        for first in range(0, len(learn), 32):
            chosen = learn[first:first + 32]
            part = [data[offsets[i]:offsets[i + 1]] for i in chosen]
            places = np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype(np.int64)
            step(model, speed, np.concatenate(part), places, y[chosen], weight[chosen])
    if len(held) and y[held].any() and not y[held].all():
        scores = np.array([model.scores(data[offsets[i]:offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0]
                           for i in held])
        _centre(model, threshold(scores, y[held]))
    return model, speed


def _centre(model: Model, middle: float) -> None:
    middle = min(max(middle, 1e-9), 1 - 1e-9)
    model.shift += float(np.log(middle / (1 - middle)))


def step(model: Model, speed: dict, data: np.ndarray, places: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """One step of Adagrad on a few texts."""
    shape, embed = model.shape, model.embed
    pooled, where, rows, x, first = model.pooled(data, places, spots=True)
    logits = pooled @ model.out - model.shift
    error = (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - y) * weight / len(y)
    into = error[:, None] * model.out * (pooled > 0)

    def move(array, key, gradient):
        speed[key] += gradient * gradient
        array -= shape.rate * gradient / np.sqrt(speed[key])

    full = np.flatnonzero(np.diff(first) > 0)
    touched, pulls = [], []
    for w, kernel in enumerate(model.filters):
        g_kernel, g_bias = np.zeros_like(kernel), np.zeros_like(model.biases[w])
        if len(full):
            own = into[full, w * shape.filters:(w + 1) * shape.filters]
            at = np.stack([where[w][t] for t in full])
            g_bias += own.sum(0)
            for j in range(len(kernel)):
                inside = (at + j < first[full + 1][:, None]) & (own != 0)
                word = np.where(inside, at + j, 0)
                g = np.where(inside, own, 0).astype(np.float32)
                g_kernel[j] += np.einsum("tf,tfs->sf", g, x[word])
                pull = (g[:, :, None] * kernel[j].T)[inside]
                touched.append(rows[word[inside]].ravel())
                pulls.append(np.repeat(pull, rows.shape[1], axis=0))
        move(kernel, ("k", w), g_kernel + 1e-4 * kernel)
        move(model.biases[w], ("b", w), g_bias)
    if touched:
        t, back = np.unique(np.concatenate(touched), return_inverse=True)
        g_embed = np.zeros((len(t), shape.size), np.float32)
        np.add.at(g_embed, back, np.concatenate(pulls))
        g_embed[t == 0] = 0
        speed["embed"][t] += g_embed ** 2
        embed[t] -= shape.rate * g_embed / np.sqrt(speed["embed"][t])
    move(model.out, "out", pooled.T @ error + 1e-4 * model.out)
    speed["shift"] += error.sum() ** 2
    model.shift += shape.rate * error.sum() / np.sqrt(speed["shift"])


def _numbers(model: Model) -> np.ndarray:
    return np.concatenate([np.ravel(a).astype(np.float64) for a in (
        model.embed, *model.filters, *model.biases, model.out, [model.shift])])


def _moved(model: Model, change: np.ndarray) -> Model:
    """The model with its numbers changed, in the order of ``_numbers``."""
    model, at = copy.deepcopy(model), 0
    for array in (model.embed, *model.filters, *model.biases, model.out):
        array += change[at:at + array.size].reshape(array.shape).astype(array.dtype)
        at += array.size
    model.shift += float(change[at])
    return model


BLOCK = 1 << 14


def refine(parts: DataFrame, model: Model, speed: dict, weights: dict[int, float]) -> Model:
    """One pass over all texts: each part (``shard``, toxic, text; a partition) goes on from the model on its own, and
    every number then changes by the mean of the changes of those parts that changed it."""
    ref = parts.sparkSession.sparkContext.broadcast((model, speed))

    def run(batches):
        base, shard = ref.value[0], None
        model, speed = copy.deepcopy(ref.value)
        for batch in batches:
            shard = batch.column("shard")[0].as_py()
            y = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.float64)
            weight = np.array([weights[int(v)] for v in y])
            for row, data, offsets in texts(pc.utf8_lower(batch.column("text"))):
                for low in range(0, len(offsets) - 1, 32):
                    high = min(low + 32, len(offsets) - 1)
                    step(model, speed, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low],
                         y[row + low:row + high], weight[row + low:row + high])
        if shard is None:
            return
        change = _numbers(model) - _numbers(base)
        for block, low in enumerate(range(0, len(change), BLOCK)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([shard], pa.int32()),
                 pa.array([change[low:low + BLOCK].tobytes()], pa.binary())], ["block", "shard", "change"])

    def mean(found: pa.Table) -> pa.Table:
        found = found.sort_by("shard")
        changes = np.stack([np.frombuffer(c) for c in found.column("change").to_pylist()])
        average = changes.sum(0) / np.maximum(1, (changes != 0).sum(0))
        return pa.table({"block": found.column("block").slice(0, 1), "change": pa.array([average.tobytes()], pa.binary())})

    blocks = parts.mapInArrow(run, "block int, shard int, change binary").groupBy("block").applyInArrow(
        mean, "block int, change binary").collect()
    return _moved(model, np.concatenate([np.frombuffer(b["change"]) for b in sorted(blocks, key=lambda b: b["block"])]))


def threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the fewest errors on both labels (shares of each); the middle of the widest if several."""
    order = np.argsort(scores)
    s, y = scores[order], labels[order]
    return cut(np.log(np.clip(s, 1e-12, 1) / np.clip(1 - s, 1e-12, 1)), y, 1 - y)


def cut(logit: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> float:
    """The same for ascending logits, with the number of texts of each label."""
    wrong = np.concatenate([[0], np.cumsum(ones)]) / max(1, ones.sum())
    below = np.concatenate([[0], np.cumsum(zeros)])
    wrong = wrong + (below[-1] - below) / max(1, zeros.sum())
    edges = np.concatenate([[logit[0] - 1], logit, [logit[-1] + 1]])
    gaps = np.diff(edges)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    best = best[np.argmax(gaps[best])]
    return float(1 / (1 + np.exp(-(edges[best] + edges[best + 1]) / 2)))


def cuts(known: DataFrame, model: Model, group: str) -> DataFrame:
    """The cut of each group (not null) that has texts of both labels, from counts of logits in steps of 1/256."""
    kept = known.where(f"{group} is not null").select("doc_id", "text", "lang", "toxic", F.col(group).alias("grp"))
    logit = F.log(F.greatest("score", F.lit(1e-12)) / F.greatest(1 - F.col("score"), F.lit(1e-12)))
    counted = (score(kept, model, ["toxic", "grp"]).groupBy("grp", F.round(logit * 256).cast("int").alias("step"))
               .agg(F.sum("toxic").alias("ones"), F.sum(1 - F.col("toxic")).alias("zeros")))

    def one(found: pa.Table) -> pa.Table:
        found = found.sort_by("step")
        steps, ones, zeros = (found.column(c).to_numpy().astype(np.float64) for c in ("step", "ones", "zeros"))
        both = ones.any() and zeros.any()
        return pa.table({"grp": found.column("grp").slice(0, int(both)),
                         "cut": pa.array([cut(steps / 256, ones, zeros)] if both else [], pa.float64())})

    kind = kept.schema["grp"].dataType.simpleString()
    return counted.groupBy("grp").applyInArrow(one, f"grp {kind}, cut double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, shape: Shape | None = None) -> Model:
    """Learns from every labelled row that is not held out, then calibrates thresholds on all of them.

    A row is learned from if crc32(doc_id as text) mod 5 is not 0; a document with several labels
    counts as toxic if one of them says so, rows with null id or label are left out. Features are
    counted over all these texts. Training begins on the ``shape.sample`` ids of each label with the
    smallest hash; then all texts, in parts that learn side by side, change that model (``refine``).
    One of five rows is kept from this pass, to place the middle of the scores. Thresholds for the
    languages are placed on all rows; other languages, and null, take 0.5. Language never enters a score.
    """
    shape, spark = shape or Shape(), documents.sparkSession
    prepare(spark)
    told = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
            .where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    known = store(documents.select("doc_id", "text", "lang").where("text is not null").join(told, "doc_id")
                  .groupBy("doc_id").agg(F.min(F.struct("toxic", "lang", "text")).alias("r")).select("doc_id", "r.*"),
                  "labelled")
    try:
        return _train(known, shape)
    finally:
        discard(known)


def _train(known: DataFrame, shape: Shape) -> Model:
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return untrained(shape)
    place = F.xxhash64("doc_id")
    fair = known.where(F.length("text") <= shape.longest_sampled).select("doc_id", "toxic")
    picked = [fair.where(F.col("toxic") == label).orderBy(place, "doc_id").limit(shape.sample) for label in sorted(totals)]
    # Their ids come first, a bounded broadcast; only their texts reach the driver.
    ids = F.broadcast(reduce(DataFrame.unionByName, picked).select("doc_id"))
    rows = known.join(ids, "doc_id", "left_semi").select("doc_id", "toxic", "text").collect()
    rows.sort(key=lambda r: r["doc_id"])

    def count(batches):
        seen = np.zeros(shape.buckets, np.int64)
        for batch in batches:
            seen += features_in(batch.column("text"), shape.buckets)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(seen[found])], ["bucket", "n"])

    parts = max(1, min(shape.most_parts, sum(totals.values()) // shape.part))
    shards = (known.withColumn("shard", F.pmod(place, F.lit(parts)).cast("int"))
              .repartitionById(parts, F.col("shard")))
    seen = np.zeros(shape.buckets, np.int64)
    for r in (shards.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket")
              .agg(F.sum("n").alias("n")).where(F.col("n") >= shape.least_texts).collect()):
        seen[r["bucket"]] = r["n"]
    if not rows:  # all of them are long
        rows = known.orderBy(F.length("text"), "doc_id").limit(1).collect()
    model, speed = begin([r["text"] for r in rows], [r["toxic"] for r in rows], shape, seen)
    if len(totals) == 2 and len(rows) < sum(totals.values()):
        kept_back = F.pmod(F.xxhash64("doc_id", F.lit(shape.seed)), F.lit(5)) == 0
        weights = {label: sum(totals.values()) / 2 / n for label, n in totals.items()}
        order = F.xxhash64("doc_id", F.lit(shape.seed + 1))
        model = refine(shards.where(~kept_back).sortWithinPartitions(order, "doc_id").select("shard", "toxic", "text"),
                       model, speed, weights)
        for r in cuts(known.where(kept_back).withColumn("whole", F.lit(0)), model, "whole").collect():
            _centre(model, r["cut"])
    for r in cuts(known, model, "lang").collect():
        # Between the language's own best cut and the common one, as a language may have few texts.
        model.thresholds[r["grp"]] = 0.5 * (r["cut"] + 0.5)
    return model


def score(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``documents``, or its columns ``keep``, with score (0 to 1), predicted (score >= 0.5) and rejected, per row.

    ``rejected`` compares the score with the threshold of the row's language. A null or empty text
    has the score of a text without words. Every column stays; columns that already have one of the
    new names give way to it. Whole texts are scored; repeated rows give repeated rows.
    """
    prepare(documents.sparkSession)
    base = documents.drop("score", "predicted", "rejected")
    names = keep or base.columns
    model_ref = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*base.select(*names).schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        model = model_ref.value
        for batch in batches:
            scores = [model.scores(data, offsets) for _, data, offsets in texts(pc.utf8_lower(batch.column("text")))]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            cuts = np.array([model.thresholds.get(x, 0.5) for x in batch.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
                 pa.array(scores >= cuts)], [*names, "score", "predicted", "rejected"])

    needed = base if keep is None else base.select(*dict.fromkeys([*keep, "text", "lang"]))
    return needed.mapInArrow(run, schema)
