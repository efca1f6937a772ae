"""Session settings, the shared scratch folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of at most this many narrow rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
# Rows of a given table that one task aggregates, sorts or writes.
TASK_ROWS = 500_000
# The JVM never compiles methods above this; wide decodes run 2-3x faster as separate projections
# than as one such method.
METHOD_BYTES = 8000

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.codegen.hugeMethodLimit": str(METHOD_BYTES),
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "changelake", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def any_size(spark: SparkSession) -> None:
    """Let recursion return as many rows as its tables give; Spark stops it at a million otherwise.

    An endless one is still stopped, by ``spark.sql.cteRecursionLevelLimit``.
    """
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")


def small_methods(spark: SparkSession) -> None:
    """The limit of ``METHOD_BYTES`` in a session that was not built here either."""
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > METHOD_BYTES:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(METHOD_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session without the setting gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="changelake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/changelake/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Fix the rows of ``df`` in the shared folder, so that later stages see the same ones."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def step(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back, by ``spark`` where that is another session: no
    executor keeps rows in memory for others. A file has at most ``TASK_ROWS``; ``stored_at`` is their place."""
    spark = spark or df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("maxRecordsPerFile", TASK_ROWS).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def parts_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Parts of about ``rows`` rows that ``df`` makes, or the session's number where that is larger."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to be small, else as it is.

    Without the hint the join shuffles and AQE splits skewed partitions.
    """
    return F.broadcast(df) if fits(df, rows) else df


def counted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same, and beyond the limit the join shuffles whatever Spark takes the size for: that of compressed files
    is a fraction of what a broadcast of their rows holds on the driver and on every executor."""
    return F.broadcast(df) if fits(df, rows) else df.hint("merge")


def few_listing_tasks(spark: SparkSession) -> None:
    """Lets Spark list many files in a few tasks a core; it makes one for each path otherwise, up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    most = 4 * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))
