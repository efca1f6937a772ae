"""Merging small files: which go together, the rewrite, and what may be removed after."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.functions.ordering import HOT_ROWS, running_total
from changelake.session import freeze, sized

MAX_FILES = 5
TARGET_BYTES = 512 << 20
# Bytes of files that one task moves or sorts; in its memory the rows take some twenty times as much.
TASK_BYTES = 32 << 20
FILES_PER_JOB = 10_000


def _useful(plan: DataFrame) -> DataFrame:
    """Groups of two files or more; a group is small, so one window per group is too."""
    return (plan.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("dir", "grp")))
            .where("_n >= 2").drop("_n"))


def plan_by_count(files: DataFrame, max_files: int = MAX_FILES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Files of a directory in path order, ``max_files`` to a group."""
    numbered = running_total(files, ["dir"], ["path"], F.lit(1).cast("bigint"), "_n", hot_rows)
    grp = F.expr(f"(_n - 1) div {max_files}")
    return _useful(numbered.select("dir", "path", "length", grp.alias("grp")))


def plan_by_bytes(files: DataFrame, target: int = TARGET_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Files below ``target`` bytes of a directory in path order, about ``target`` to a group."""
    small = files.where(F.col("length") < target)
    placed = running_total(small, ["dir"], ["path"], F.col("length"), "_end", hot_rows)
    grp = F.expr(f"(_end - length) div {target}")
    return _useful(placed.select("dir", "path", "length", grp.alias("grp")))


def scanned_path() -> Column:
    """Path of the file a scanned row comes from, in the spelling of a file listing."""
    return listing_spelling(F.col("_metadata.file_path"))


def listing_spelling(path: Column) -> Column:
    """The path of a scanned file in that spelling."""
    return listed_path(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def listed_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:///")


def paths_of(files: DataFrame) -> list[str]:
    """File names for a reader, which keeps the same list in its file index."""
    return [row.path for row in files.select("path").collect()]


def jobs(plan: DataFrame, files_per_job: int = FILES_PER_JOB) -> Iterator[DataFrame]:
    """The plan in parts of about ``files_per_job`` files; a group stays whole."""
    parts = -(-plan.count() // files_per_job)
    for part in range(parts):
        yield plan.where(F.pmod(F.xxhash64("dir", "grp"), F.lit(parts)) == part)


def rewrite(spark: SparkSession, plan: DataFrame, out: str, target: int = TARGET_BYTES,
            files_per_job: int = FILES_PER_JOB, schemas: Mapping[str, T.StructType] | None = None) -> DataFrame:
    """Write the rows of each group to a directory of its own below ``out``.

    A group becomes one file per ``target`` bytes, at most ``TASK_BYTES``, so one huge group is many
    tasks. ``schemas`` has the schema of each ``dir``; without it, a job's files are read with their
    merged schema, so that columns that some files lack are NULL there (types that do not merge are
    an error).
    Rows and the values of every column are counted before and after, before the result, one
    row per written file, is returned: dir, grp, path, record_count, bytes. The replaced files
    stay until ``vacuum``.
    """
    plan = freeze(plan.withColumn("path", listed_path(F.col("path"))))
    for number, part in enumerate(jobs(plan, files_per_job)):
        for place, (name, schema) in enumerate((schemas or {None: None}).items()):
            _rewrite_job(spark, part if name is None else part.where(F.col("dir") == name),
                         f"{out}/job={number}-{place}", target, schema)
    if plan.isEmpty():
        return plan.select("dir", "grp", "path", F.lit(0).cast("bigint").alias("record_count"),
                           F.col("length").alias("bytes"))
    written = (spark.read.option("basePath", out).parquet(out)
               .groupBy(scanned_path().alias("path"), "group_id")
               .agg(F.count(F.lit(1)).alias("record_count"),
                    F.first("_metadata.file_size").alias("bytes")))
    ids = plan.select("dir", "grp", _group_id().alias("group_id")).distinct()
    return written.join(ids, "group_id").select("dir", "grp", "path", "record_count", "bytes")


def _group_id() -> Column:
    return F.concat(F.lower(F.hex(F.xxhash64("dir"))), F.lit("-"), F.col("grp"))


def _filled(rows: DataFrame, columns: list[str]) -> dict[str, int]:
    """Rows, and rows with a value in each column."""
    return rows.agg(F.count(F.lit(1)).alias("*"), *(F.count(f"`{c}`").alias(c) for c in columns)).first().asDict()


def _rewrite_job(spark: SparkSession, plan: DataFrame, out: str, target: int,
                 schema: T.StructType | None) -> None:
    files = plan.select("path", _group_id().alias("group_id"), "length").collect()
    if not files:
        return
    sizes: Counter[str] = Counter()
    for f in files:
        sizes[f.group_id] += f.length
    # Tasks are numbered, not hashed: of a few hashed ones some would get most of the rows.
    pieces = {g: max(1, -(-size // min(target, TASK_BYTES))) for g, size in sizes.items()}
    first = dict(zip(pieces, accumulate(pieces.values(), initial=0)))
    placed = spark.createDataFrame([(f.path, f.group_id, first[f.group_id], pieces[f.group_id]) for f in files],
                                   "_path STRING, group_id STRING, _first INT, _pieces INT")
    paths = [f.path for f in files]
    # All files of a job have one schema, given or merged: none may hide another's columns.
    schema = schema or spark.read.option("mergeSchema", "true").parquet(*paths).schema
    rows = spark.read.schema(schema).parquet(*paths)
    columns = rows.columns
    grouped = rows.select("*", scanned_path().alias("_path"),
                          F.col("_metadata.row_index").alias("_row")).join(sized(placed), "_path")
    piece = (F.col("_first") + F.pmod("_row", "_pieces")).cast("int")
    (grouped.withColumn("_piece", piece).repartitionById(sum(pieces.values()), F.col("_piece"))
     .select("group_id", *columns).write.mode("overwrite").partitionBy("group_id").parquet(out))
    written = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    before, after = _filled(rows, columns), _filled(written, columns)
    if before != after:
        raise RuntimeError(f"rewrite of {before} wrote {after}; nothing was replaced")


STATS = """dir STRING, grp BIGINT, files_before BIGINT, bytes_before BIGINT, files_after BIGINT,
           bytes_after BIGINT, rows BIGINT, bytes_saved BIGINT"""


def cluster(spark: SparkSession, files: Sequence[Row], out: str, order: Sequence[str], target: int,
            schema: str) -> list[dict]:
    """Write the rows of files of one schema again, in about ``target`` bytes a file (at most about
    ``TASK_BYTES``, which one task sorts) and ordered by ``order`` over all of them: ranges of its
    first column hardly overlap.

    ``files`` have path, bytes and record_count. The rows are read once (and sampled, if they make several
    files) and counted as they are written. Returns path, record_count, bytes, and low and high of
    the first column for each new file.
    """
    pieces = max(1, -(-sum(f.bytes for f in files) // min(target, TASK_BYTES)))
    rows = spark.read.schema(schema).parquet(*(f.path for f in files))
    placed = rows.repartitionByRange(pieces, *order) if pieces > 1 else rows.coalesce(1)
    seen = Observation()
    placed.sortWithinPartitions(*order).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(out)
    expected = sum(f.record_count for f in files)
    if seen.get["rows"] != expected:
        raise RuntimeError(f"rewrite of {expected} rows wrote {seen.get['rows']}; nothing was replaced")
    written = spark.read.schema(schema).parquet(out).groupBy(scanned_path().alias("path")).agg(
        F.count(F.lit(1)).alias("record_count"), F.first("_metadata.file_size").alias("bytes"),
        F.min(order[0]).alias("low"), F.max(order[0]).alias("high"))
    return [r.asDict() for r in written.collect()]


def compaction_stats(plan: DataFrame, written: DataFrame) -> DataFrame:
    """Per group: files and bytes before and after, and the bytes saved."""
    before = plan.groupBy("dir", "grp").agg(
        F.count(F.lit(1)).alias("files_before"), F.sum("length").alias("bytes_before"))
    after = written.groupBy("dir", "grp").agg(
        F.count(F.lit(1)).alias("files_after"), F.sum("bytes").alias("bytes_after"),
        F.sum("record_count").alias("rows"))
    return before.join(after, ["dir", "grp"]).withColumn(
        "bytes_saved", F.col("bytes_before") - F.col("bytes_after"))


def run_totals(stats: DataFrame, tables: int, seconds: float) -> DataFrame:
    """One row for the compaction log."""
    zero = F.lit(0).cast("bigint")
    return stats.agg(
        F.lit(tables).cast("bigint").alias("tables_processed"),
        F.coalesce(F.sum("files_before"), zero).alias("files_processed"),
        F.coalesce(F.sum("files_before"), zero).alias("files_compacted"),
        F.coalesce(F.sum("bytes_saved"), zero).alias("bytes_saved"),
        F.lit(float(seconds)).alias("seconds"))


def vacuum_candidates(inventory: DataFrame, live: DataFrame, older_than) -> DataFrame:
    """Files that no snapshot needs and that are older than the retention time."""
    listed = inventory.withColumn("path", listed_path(F.col("path")))
    return (listed.where(F.col("modificationTime") < F.lit(older_than))
            .join(live.select(listed_path(F.col("path")).alias("path")), "path", "left_anti"))


def remove_files(spark: SparkSession, files: DataFrame) -> int:
    """Delete the files, streaming their names past the driver. Returns how many went."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    removed = 0
    for row in files.select("path").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(row.path)
        removed += bool(path.getFileSystem(conf).delete(path, False))
    return removed
