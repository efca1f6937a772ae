"""Shared pieces: stored steps, text as byte arrays, and polynomial hashes of byte spans."""

from __future__ import annotations

import functools
import gc
import pathlib
import tempfile
import weakref
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import changelake
from changelake.session import scratch_path
from changelake.sources.logs import remove

# Bytes of text that one numpy step works on; a longer text is one step of its own.
STEP = 1 << 17
# Bytes that may be broadcast, once they are summed.
BROADCAST_BYTES = 16 << 20


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*steps: DataFrame) -> None:
    """Deletes stored steps that nothing will read any more; what was computed from them is stored."""
    for step in steps:
        remove(step.sparkSession, step.stored_at)


def tidy(spark: SparkSession) -> None:
    """Lets the driver forget finished queries, upon which Spark deletes their shuffle files too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def prepare(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets Python workers run this package's functions on batches of whole texts.

    Arrow batches hold ``most`` bytes (or one row), as texts can be long; this holds for later plans.
    The package goes to the executors once for each application, as they may not have it installed.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    context = spark.sparkContext
    if context not in _SHIPPED:
        package = pathlib.Path(changelake.__file__).parent
        archive = pathlib.Path(tempfile.mkdtemp(prefix="changelake-")) / "changelake.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context)


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow; what Arrow holds unused goes back at its end, as the worker waits for other tasks."""
    def ran(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
    return ran


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of ``df``."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def hinted(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table with a broadcast hint, if ``size`` (bytes a row) was summed to be small.

    Beyond the limit the join shuffles, and AQE splits skewed partitions.
    """
    total = df.agg(F.sum(size + F.lit(32))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def texts(column: pa.Array, step: int = STEP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets) of consecutive texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, places, content = column.buffers()
    rows = len(column)
    if not rows:
        return
    offsets = np.frombuffer(places, np.int64)[column.offset:column.offset + rows + 1]
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    row = 0
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + step, "right")) - 1)
        low, high = int(offsets[row]), int(offsets[stop])
        yield row, data[low:high], offsets[row:stop + 1] - low
        row = stop


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    values = values ^ (values >> np.uint64(32))
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values


class SpanHash:
    """64-bit polynomial hashes of any byte span, by running sums."""

    def __init__(self, seed: int, fold: bool = False):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 2**64, 256, dtype=np.uint64)
        if fold:
            self.values[65:91] = self.values[97:123]
        base = int(rng.integers(0, 2**63)) * 2 + 1
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if size > len(self.up):
            size = max(size, STEP + 1024)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                table = np.full(size, factor, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        part = self.values[data]
        part *= self.up[:len(data)]
        np.cumsum(part, out=out[1:])
        return out

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """The hashes of all spans of one width."""
        count = len(sums) - width
        out = sums[width:] - sums[:count]
        out *= self.down[:count]
        return mix(out)

    def spans(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((sums[stop] - sums[start]) * self.down[start])


@functools.cache
def span_hash(seed: int, fold: bool = False) -> SpanHash:
    return SpanHash(seed, fold)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE):
    """(starts, stops, first word of each text): maximal runs of bytes that are no white space."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def longs(values) -> pa.Array:
    """Unsigned 64-bit values as signed ones, bit by bit."""
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def blobs(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array from joined values and their ends."""
    offsets = np.zeros(len(ends) + 1, np.int64)
    offsets[1:] = ends
    if isinstance(data, np.ndarray):
        data = data.tobytes()
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]
    ).cast(pa.binary())
