"""Relation messages: versions of a table's shape, and the version a change row belongs to."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.functions.ordering import HOT_ROWS, bisect, neighbour
from changelake.functions.types import can_be_unchanged, spark_type, wider
from changelake.session import BROADCAST_ROWS, freeze

def relation_versions(changes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per shape: relation_id, relation, valid_from, valid_to (NULL for the newest).

    A relation message is sent again in every session, so repeats of the same shape go first.
    The versions are read several times (shapes, size check, binding), so they are fixed once.
    """
    messages = changes.where("kind = 'relation'").select(
        "relation_id", "lsn", "seq", "relation")
    compared = neighbour(messages.withColumn("_text", F.to_json(F.struct("relation"))),
                         ["relation_id"], ["lsn", "seq"], "_text", "_before", -1, hot_rows)
    shapes = compared.where(~F.col("_text").eqNullSafe(F.col("_before"))).select(
        "relation_id", "relation", F.struct("lsn", "seq").alias("valid_from"))
    return freeze(neighbour(shapes, ["relation_id"], ["valid_from"], "valid_from", "valid_to",
                            hot_rows=hot_rows))


# Positions of one node of the tree of a relation's versions.
FANOUT = 32


class Sizes(NamedTuple):
    """How many relation versions there are, and how many the relation with most of them has."""

    versions: int
    longest: int

    @classmethod
    def of(cls, versions: DataFrame) -> Sizes:
        counts = versions.groupBy("relation_id").agg(F.count(F.lit(1)).alias("n"))
        return cls(*counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first())


def bind_relation(changes: DataFrame, versions: DataFrame, keep_unknown: bool = False,
                  sizes: Sizes | None = None) -> DataFrame:
    """Each change row with the ``relation`` in force at its position (as-of join).

    A relation's versions, in order, are the leaves of a tree whose nodes are sorted arrays of at most
    ``FANOUT`` positions. A row goes down by equality joins, one a level, and halves the array it meets:
    it costs the logarithm of the number of versions, and neither rows nor versions are copied.
    Versions of a counted size are broadcast; beyond it the joins shuffle, and the lower levels
    spread a busy relation. ``sizes`` saves the count where the caller knows it.
    Rows before the first relation message have none; ``keep_unknown`` keeps them.
    """
    sizes = Sizes.of(versions) if sizes is None else sizes
    near = F.broadcast if sizes.versions <= BROADCAST_ROWS else (lambda df: df)
    found = [c for c in versions.columns if c not in ("relation_id", "valid_from", "valid_to")]
    ordered = versions.groupBy(F.col("relation_id").alias("_id")).agg(F.sort_array(F.collect_list(
        F.struct("valid_from", F.struct(*found).alias("_found")))).alias("_all"))
    leaves = ordered.select("_id", F.posexplode("_all").alias("_n", "_e"))
    rows = changes.drop("relation")
    bound, span = rows.withColumn("_n", F.lit(0)), FANOUT
    while span < sizes.longest:
        span *= FANOUT
    while span > 1:
        # Nodes of this level span so many leaves; their entries are the first ones of their children.
        below = span // FANOUT
        nodes = leaves.where(F.col("_n") % below == 0).groupBy("_id", F.expr(f"_n div {span}").cast("int").alias("_m")).agg(
            F.sort_array(F.collect_list("_e.valid_from")).alias("_starts"))
        on = (F.col("relation_id") == F.col("_id")) & (F.col("_n") == F.col("_m"))
        child = F.col("_n") * FANOUT + bisect(F.col("_starts"), F.struct("lsn", "seq"), FANOUT) - 1
        bound = bound.join(near(nodes), on, "left").select(
            *rows.columns, F.when(child >= F.col("_n") * FANOUT, child).cast("int").alias("_n"))
        span = below
    on = (F.col("relation_id") == F.col("_id")) & (F.col("_n") == F.col("_m"))
    side = leaves.select("_id", F.col("_n").alias("_m"), F.col("_e._found").alias("_found"))
    return bound.join(near(side), on, "left" if keep_unknown else "inner").select(
        *rows.columns, *(F.col(f"_found.{c}").alias(c) for c in found))


def unknown_relation(changes: DataFrame, versions: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """Rows whose relation had not been described yet."""
    return bind_relation(changes, versions, True, sizes).where("relation IS NULL")


def merge_nullability(columns: DataFrame, known: DataFrame) -> DataFrame:
    """Columns of relation messages with nullability and type name from what is known by name.

    Relation messages carry neither; an unknown column is nullable.
    """
    prior = known.select("namespace", "name", "column_name",
                         F.col("nullable").alias("_nullable"), F.col("type_name").alias("_type"))
    joined = columns.drop("nullable", "type_name").join(
        prior, ["namespace", "name", "column_name"], "left")
    return joined.select(
        *[c for c in joined.columns if c not in ("_nullable", "_type")],
        F.coalesce("_nullable", F.lit(True)).alias("nullable"),
        F.coalesce("_type", F.lit("")).alias("type_name"))


def shape_columns(versions: DataFrame) -> DataFrame:
    """Relation versions in long form, one row per column, numbered from 1."""
    return versions.select(
        "relation_id", F.col("relation.namespace").alias("namespace"),
        F.col("relation.name").alias("name"), "valid_from",
        F.posexplode("relation.columns").alias("_i", "_c")
    ).select("relation_id", "namespace", "name", "valid_from", (F.col("_i") + 1).alias("field_id"),
             F.col("_c.name").alias("column_name"), F.col("_c.oid").alias("type_oid"),
             F.col("_c.typmod").alias("typmod"), F.col("_c.is_key").alias("is_key"))


class TableShape:
    """Typed columns of one table over all versions of its shape.

    A column that was dropped and added again under its name is another column: it is kept as
    ``<name>__2`` (and so on), and read under the name. ``names`` has the source's name of each
    column, ``since`` the versions (from, to) that have a column whose name had several.
    """

    def __init__(self, namespace: str, name: str, columns: Sequence[tuple[str, int, int, bool]],
                 required: Sequence[str] = ()):
        self.namespace, self.name, self.required = namespace, name, list(required)
        self.types: dict[str, T.DataType] = {}
        self.keys: list[str] = []
        self.carried: list[str] = []
        self.names: dict[str, str] = {}
        self.since: dict[str, tuple[tuple | None, tuple | None]] = {}
        for column, oid, typmod, is_key in columns:
            self.add(column, oid, typmod, is_key)

    def add(self, column: str, oid: int, typmod: int = -1, is_key: bool = False, name: str | None = None) -> None:
        new = spark_type(oid, typmod)
        self.types[column] = wider(self.types.get(column, new), new)
        self.names[column] = name or column
        if is_key and column not in self.keys:
            self.keys.append(column)
        if can_be_unchanged(oid) and column not in self.carried:
            self.carried.append(column)

    @property
    def visible(self) -> dict[str, str]:
        """The column that is read under each name: the last that had it."""
        return {self.names.get(c, c): c for c in self.types}

    @property
    def full_name(self) -> str:
        return f"{self.namespace}.{self.name}"

    @property
    def values(self) -> list[str]:
        return [c for c in self.types if c not in self.keys]

    @property
    def carried_values(self) -> list[str]:
        return [c for c in self.carried if c not in self.keys]

    def struct_type(self) -> T.StructType:
        """Columns in order, with their field number; NULL allowed unless required."""
        return T.StructType([
            T.StructField(c, t, c not in self.required, {"field_id": i})
            for i, (c, t) in enumerate(self.types.items(), 1)])

    def to_json(self) -> str:
        """The columns as text, kept with the files written in this shape."""
        return json.dumps({"schema": self.struct_type().jsonValue(), "keys": self.keys,
                           "carried": self.carried, "names": {c: n for c, n in self.names.items() if c != n}})

    @classmethod
    def from_json(cls, namespace: str, name: str, text: str) -> TableShape:
        saved = json.loads(text)
        shape = cls(namespace, name, [])
        schema = T.StructType.fromJson(saved["schema"])
        shape.types = {f.name: f.dataType for f in schema}
        shape.required = [f.name for f in schema if not f.nullable]
        shape.keys, shape.carried = saved["keys"], saved["carried"]
        shape.names = {c: saved["names"].get(c, c) for c in shape.types}
        return shape

    @classmethod
    def from_schema(cls, namespace: str, name: str, schema: T.StructType, keys: Iterable[str]) -> TableShape:
        """The shape of a table that is known by its rows only."""
        shape = cls(namespace, name, [])
        shape.types, shape.keys = {f.name: f.dataType for f in schema}, list(keys)
        shape.names = {c: c for c in shape.types}
        return shape

    @classmethod
    def of(cls, versions: DataFrame, namespace: str, name: str,
           required: Sequence[str] = ()) -> TableShape:
        """Union of the table's versions, oldest first. Only column descriptions are fetched, of
        the versions in which a column comes, goes or changes."""
        own = versions.where((F.col("relation.namespace") == namespace) & (F.col("relation.name") == name))
        columns = own.select("valid_from", F.posexplode("relation.columns").alias("_i", "_c")).groupBy("valid_from").agg(
            F.sort_array(F.collect_list(F.struct("_i", "_c.name", "_c.oid", "_c.typmod", "_c.is_key"))).alias("columns"))
        rows = columns.orderBy("valid_from").collect()
        shape, held, epoch = cls(namespace, name, [], required), {}, {}
        for row in rows:
            here = {c.name for c in row.columns}
            for gone in set(held) - here:
                start, _ = shape.since.get(held[gone], (None, None))
                shape.since[held.pop(gone)] = start, tuple(row.valid_from)
            for c in row.columns:
                if c.name not in held:
                    epoch[c.name] = epoch.get(c.name, 0) + 1
                    held[c.name] = c.name if epoch[c.name] == 1 else f"{c.name}__{epoch[c.name]}"
                    if epoch[c.name] > 1:
                        shape.since[held[c.name]] = tuple(row.valid_from), None
                shape.add(held[c.name], c.oid, -1 if c.typmod is None else c.typmod, c.is_key, c.name)
        shape.since = {c: s for c, s in shape.since.items() if epoch[shape.names[c]] > 1}
        # Versions that lack a column leave it as it is.
        always = set.intersection(*({c.name for c in row.columns} for row in rows)) if rows else set()
        shape.carried += [c for c in shape.types if c not in shape.carried and (shape.names[c] not in always or c in shape.since)]
        return shape


def union_schema(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows written under different schemas as one table; a missing column is NULL and a
    column of two types gets their common one."""
    types: dict[str, T.DataType] = {}
    for part in parts:
        for field in part.schema:
            types[field.name] = wider(types.get(field.name, field.dataType), field.dataType)
    cast = [p.select(*[F.col(c).cast(types[c]) for c in p.columns]) for p in parts]
    result = cast[0]
    for part in cast[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result.select(*types)
