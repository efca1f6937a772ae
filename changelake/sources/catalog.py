"""Catalog rows: columns, types, classes and namespaces of the source database."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake.functions.types import SOURCE_TYPES
from changelake.session import sized


def known_types(spark: SparkSession) -> DataFrame:
    """The type map as rows, for schema reports."""
    return spark.createDataFrame(
        [(oid, name, table) for oid, (name, table) in SOURCE_TYPES.items()],
        "type_oid BIGINT, type_name STRING, table_type STRING")


def read_jdbc(spark: SparkSession, url: str, table: str, options: dict[str, str]) -> DataFrame:
    """A catalog table from the source database, where its JDBC driver is deployed."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_columns(columns: DataFrame, types: DataFrame,
                 tables: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """Columns with their type OID, for all tables or the given (schema, table) pairs.

    Types are matched by namespace and name, so equal type names do not duplicate columns.
    """
    if tables is not None:
        wanted = columns.sparkSession.createDataFrame(
            list(tables), "table_schema STRING, table_name STRING")
        columns = columns.join(F.broadcast(wanted), ["table_schema", "table_name"], "left_semi")
    typed = columns.join(sized(types), (columns.udt_schema == types.type_namespace)
                         & (columns.udt_name == types.type_name))
    return typed.select(
        "table_schema", "table_name", "ordinal_position", "column_name", "type_oid", "type_name",
        (F.col("is_nullable") == "YES").alias("nullable"))


def relation_ids(classes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(namespace, name) -> relation id."""
    return classes.join(sized(namespaces), "namespace_oid").select(
        "namespace", "name", "relation_id")


def table_schemas(columns: DataFrame) -> DataFrame:
    """One row per table with its columns in order, numbered from 1.

    The list is bounded: a source table has at most 1,600 columns.
    """
    entry = F.struct("ordinal_position", "column_name", "type_oid", "type_name", "nullable")
    ordered = F.sort_array(F.collect_list(entry))
    numbered = F.transform(ordered, lambda c, i: F.struct(
        (i + 1).alias("field_id"), c.column_name.alias("name"), c.type_oid.alias("type_oid"),
        c.type_name.alias("type_name"), c.nullable.alias("nullable")))
    return columns.groupBy("table_schema", "table_name").agg(numbered.alias("columns"))
