"""The change feed: one row per message, in the order ``(lsn, seq)``."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tuple kinds in ``f``: n NULL, t text, b binary (hexadecimal), u unchanged.
CHANGES = """
    lsn BIGINT, seq INT, xid BIGINT, sub_xid BIGINT, kind STRING, event_ts TIMESTAMP,
    relation_id BIGINT,
    new_cols ARRAY<STRUCT<f: STRING, v: STRING>>,
    old_cols ARRAY<STRUCT<f: STRING, v: STRING>>,
    relation STRUCT<namespace: STRING, name: STRING,
                    columns: ARRAY<STRUCT<name: STRING, oid: BIGINT, typmod: INT, is_key: BOOLEAN>>>
"""

# Message kinds.
ROW_KINDS = ("insert", "update", "delete", "truncate")
COMMITS = ("commit", "stream_commit")
ABORTS = ("stream_abort",)


def read_changes(spark: SparkSession, path: str, format: str = "parquet", streaming: bool = False,
                 start: int = 0, max_files: int | None = None) -> DataFrame:
    """Change files below ``path`` from position ``start`` on, as a batch or a stream.

    JSON files have a message a line; a line that is none becomes a message of kind ``malformed``,
    which has no position, so it is kept whatever ``start`` is. Blank lines are no messages.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if format == "json":
        # A stream has no row numbers; a batch of it is read once, so any name for a line will do.
        line = F.expr("uuid()") if streaming else F.monotonically_increasing_id()
        lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("_file"), line.alias("_line"))
        changes = from_json_text(lines.where(F.trim("value") != ""), place=("_file", "_line"))
    else:
        changes = reader.schema(CHANGES).format(format).load(path)
    return changes.where((F.col("lsn") >= start) | (F.col("kind") == "malformed")) if start else changes


def read_kafka(spark: SparkSession, options: dict[str, str], streaming: bool = True) -> DataFrame:
    """The same feed from a Kafka topic of JSON envelopes (needs Spark's Kafka package)."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").options(**options)
    texts = reader.load().selectExpr("CAST(value AS STRING) AS value", "topic", "partition", "offset")
    return from_json_text(texts, place=("topic", "partition", "offset"))


def from_json_text(rows: DataFrame, column: str = "value", place: Sequence[str] = ()) -> DataFrame:
    """Messages from JSON text. Text that is no envelope becomes a message of kind ``malformed``
    that carries the text as its only cell, below all positions, so that it is seen and counted.

    ``place`` names the columns that tell where a text came from: equal texts from two places count
    twice, and one that is delivered again counts once.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = rows.select(F.from_json(column, CHANGES + ", _corrupt STRING", options).alias("c"),
                         F.col(column).alias("_text"), *place)
    bad = F.col("c._corrupt").isNotNull() | F.col("c.kind").isNull() | F.col("c.lsn").isNull()
    cells = {f.name: F.col(f"c.{f.name}") for f in parsed.schema["c"].dataType.fields if f.name != "_corrupt"}
    instead = {"kind": F.lit("malformed"), "seq": F.lit(0),
               "lsn": -F.shiftrightunsigned(F.xxhash64("_text", *place), 1) - 1,
               "new_cols": F.array(F.struct(F.lit("t").alias("f"), F.col("_text").alias("v")))}
    return parsed.select(*(F.when(~bad, cell).otherwise(instead.get(n, F.lit(None))).alias(n)
                           for n, cell in cells.items()))


def rows_only(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("kind").isin(*ROW_KINDS))


def select_tables(changes: DataFrame, wanted: Iterable[tuple[str, str]]) -> DataFrame:
    """Changes of the configured (namespace, name) pairs. The pairs come from configuration."""
    names = changes.sparkSession.createDataFrame(list(wanted), "namespace STRING, name STRING")
    return changes.join(F.broadcast(names), ["namespace", "name"], "left_semi")
