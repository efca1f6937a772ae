"""Packing by shortest-pack-first over the length histogram.

Documents longer than a sequence give whole sequences and a rest. The histogram of piece lengths,
at most one entry a length, is packed on the driver: lengths longest first, each into the pack
with the most room, whole counts at a time. Every pattern of lengths owns a range of sequences,
and pieces find theirs by their rank among the pieces of their length.
"""

from __future__ import annotations

import array
import bisect
import functools
import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelake.llm.common import prepare, store

# Words, and pieces, that a worker keeps: about 200 bytes each.
REMEMBERED = 600_000
CLOSING = 2


def pack_histogram(histogram: Mapping[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a pattern, how many sequences have it)] with shortest-pack-first."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by used length
    used: list[int] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            # The shortest packs are those with the most room.
            if used and used[0] + length <= size:
                at = used[0]
                pattern, count = open_packs[at].pop()
                take = min(left, count)
                if count > take:
                    open_packs[at].append((pattern, count - take))
                if not open_packs[at]:
                    del open_packs[at], used[0]
            else:
                at, pattern, take = 0, (), left
            left -= take
            if at + length not in open_packs:
                open_packs[at + length] = []
                bisect.insort(used, at + length)
            open_packs[at + length].append(((*pattern, length), take))
    return [pack for at in sorted(open_packs, reverse=True) for pack in open_packs[at]]


def places(patterns: list[tuple[tuple[int, ...], int]]):
    """Arrays (length, first rank, first sequence, offset), ordered by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, ranks.get(length, 0), sequence, offset))
            ranks[length] = ranks.get(length, 0) + count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4).T


# The tokenizer's own division of words, for the Latin letters below U+0180 (lower case). None of them
# changes under its normal form, and U+0130 alone has a lower case of two letters.
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
# Special tokens and all other letters are left to the tokenizer.
OTHER = re.compile("<\\||[^\x00-\u012f\u0131-\u017f]")


class WordIds:
    """Ids of texts with the tokenizers library; each distinct word, and piece of one, is encoded once."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.remembered, self.tokenizer = remembered, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Pieces need neither the normal form nor the division again.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @staticmethod
    def _each(tokenizer, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for word, found in zip(words, tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            yield word, array.array("I", found.ids).tobytes()

    def _learn(self, fresh: list[str]) -> None:
        if len(self.parts) > self.remembered:
            self.parts.clear()
        other = [w for w in fresh if OTHER.search(w)]
        plain = [w for w in fresh if not OTHER.search(w)] if other else fresh
        cut = [PIECE.findall(w.lower()) for w in plain]
        self.parts.update(self._each(self.bare, list(set().union(*cut).difference(self.parts))))
        part = self.parts.__getitem__
        for word, pieces in zip(plain, cut, strict=True):
            self.known[word] = b"".join(map(part, pieces))
        self.known.update(self._each(self.tokenizer, other))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids. White space divides words and is no token, so words stand alone.

        Arrow splits a batch and numbers its distinct words. Arrow and Python also split at four
        separators that the tokenizer takes for letters; texts with these are encoded whole.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = pc.match_substring_regex(texts, "[\x1c-\x1f]")
        lists = pc.utf8_split_whitespace(pc.if_else(whole, "", texts))
        coded = lists.flatten().dictionary_encode()
        words, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        if len(known) > self.remembered:
            # What this batch has stays: frequent words among them.
            known = self.known = {w: known[w] for w in words if w in known}
        self._learn([w for w in words if w not in known])
        held = [known[w] for w in words]
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        begins = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        # Where each id of the batch lies among the ids of its distinct words.
        spots = np.repeat((begins[at] - ends[:-1]).astype(np.int32), sizes[at])
        spots += np.arange(len(spots), dtype=np.int32)
        data = np.frombuffer(b"".join(held), "<u4")[spots].tobytes()
        edges = (4 * ends[lists.offsets.to_numpy()]).tolist()
        for i, odd in enumerate(whole.to_pylist()):
            if odd:
                found = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False)
                yield np.array(found.ids, "<u4").tobytes()
            else:
                yield data[edges[i]:edges[i + 1]]


@functools.cache
def word_ids(path: str, remembered: int) -> WordIds:
    return WordIds(path, remembered)


def pieces(documents: DataFrame, path: str, size: int, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part, place): documents cut to sequences.

    ``place`` counts the pieces of one length within the partition ``part``.
    """
    prepare(documents.sparkSession)

    def cut(batches):
        from pyspark import TaskContext

        encoder, part, seen = word_ids(path, remembered), TaskContext.get().partitionId(), {}
        closing = np.array([CLOSING], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                data += closing
                total = len(data) // 4
                for start in range(0, total, size):
                    length = min(size, total - start)
                    place = seen[length] = seen.get(length, -1) + 1
                    rows.append((doc, start, length, zlib.crc32(data[4 * start:4 * (start + length)]),
                                 total, part, place))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.int32(), pa.int64()], strict=True)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long")


def pack(documents: DataFrame, path: str, size: int = 4096, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): each document's pieces.

    A null or empty text is the closing id alone. Every row is a document of its own, so repeated
    rows are packed as often as they come; other columns are left out; an empty table gives an empty
    one. Only the histogram (``size`` entries at most) and the patterns, whose number it bounds,
    meet the driver. Ranks within a length come from counts by partition, so that a length that a
    third of all pieces share is still numbered where they lie. ``remembered`` bounds the words that a
    worker keeps encoded; fewer need less memory and more time.
    """
    cut = store(pieces(documents, path, size, remembered), "pieces")
    counts = cut.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = places(pack_histogram(histogram, size))
    ranked = cut.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))

    def place(batches):
        lengths, firsts, sequences, starts = table
        bound = int(firsts.max(initial=0)) + 1
        keys = lengths * bound + firsts
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            # A rank beyond the last first rank of any length still belongs to its length's last place.
            at = np.searchsorted(keys, length * bound + np.minimum(rank, bound - 1), "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")),
                 pa.array(sequences[at] + rank - firsts[at]), pa.array(starts[at])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
