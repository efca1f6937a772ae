"""Positional text tuples to typed columns, and the rows that do not fit.

Each row is first bound to the version of its table that was in force at its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.functions.types import decode_binary, decode_text
from changelake.operators.relations import Sizes, TableShape, bind_relation
from changelake.operators.state import flag
from changelake.session import small_methods

POSITIONS = ["lsn", "seq", "xid", "sub_xid", "kind", "relation_id"]


def tuple_map(tuple_column: str = "new_cols") -> Column:
    """A tuple as a map from column name to (kind, text), for tables without a fixed shape."""
    names = F.transform("relation.columns", lambda c: c.getField("name"))
    return F.map_from_arrays(names, tuple_column)


def bind(rows: DataFrame, versions: DataFrame, shape: TableShape, sizes: Sizes | None = None) -> DataFrame:
    """Rows of one table with ``at``: where each of the shape's columns sits in the tuple.

    The places are worked out once per version, not per row; a column that a version lacks has
    no place, and reads as NULL.
    """
    names = F.transform("relation.columns", lambda c: c.getField("name"))
    own = versions.where((F.col("relation.namespace") == shape.namespace)
                         & (F.col("relation.name") == shape.name))

    def place(column: str) -> Column:
        found = (F.nullif(F.array_position(names, shape.names[column]), F.lit(0)) - 1).cast("int")
        first, last = shape.since.get(column, (None, None))
        for bound, there in ((first, True), (last, False)):
            if bound is not None:
                from_there = F.col("valid_from") >= F.struct(F.lit(bound[0]).cast("bigint"), F.lit(bound[1]).cast("int"))
                found = F.when(from_there if there else ~from_there, found)
        return found

    placed = own.select("relation_id", "valid_from", "valid_to", F.size("relation.columns").alias("width"),
                        F.array(*map(place, shape.types)).alias("at"))
    return bind_relation(rows, placed, sizes=sizes)


def to_columns(rows: DataFrame, shape: TableShape) -> DataFrame:
    """Typed columns of one table, ``<column>_f`` for those that may come unchanged, and
    ``old_<key>`` for updates that send the old key. ``unfit`` is the first reason why a row
    cannot be used (NULL if it can) and ``reasons`` are all of them."""
    small_methods(rows.sparkSession)
    deleted = F.col("kind") == "delete"
    cells: dict[str, Column] = {}
    for i, name in enumerate(shape.types):
        place = F.get("at", F.lit(i))
        cells[f"_t_{name}"] = F.get("new_cols", place)
        if name in shape.keys:
            # A delete names its row by the old tuple.
            cells[f"_o_{name}"] = F.get("old_cols", place)
            cells[f"_t_{name}"] = F.when(
                deleted, F.coalesce(cells[f"_o_{name}"], cells[f"_t_{name}"])
            ).otherwise(cells[f"_t_{name}"])
        elif name in shape.carried_values:
            # A full old tuple has the value that the new one leaves out. The old tuple of a key
            # alone has NULL for the others, which says nothing.
            new, old = cells[f"_t_{name}"], F.get("old_cols", place)
            cells[f"_t_{name}"] = F.when((new["f"] == "u") & old["f"].isin("t", "b"), old).otherwise(new)
    rows = rows.withColumns(cells)
    places = {name: i for i, name in enumerate(shape.types)}
    typed: dict[str, Column] = {}
    for name, data_type in shape.types.items():
        kind, text = F.col(f"_t_{name}.f"), F.col(f"_t_{name}.v")
        typed[name] = _decoded(kind, text, data_type)
        if name in shape.carried_values:
            absent = F.get("at", F.lit(places[name])).isNull() & (F.col("kind") == "update")
            typed[flag(name)] = F.when(deleted, "n").when(absent, "a").otherwise(F.coalesce(kind, F.lit("n")))
    for key in shape.keys:
        old = F.when(F.col("kind") == "update", F.col(f"_o_{key}.v"))
        typed[f"old_{key}"] = _decoded(F.col(f"_o_{key}.f"), old, shape.types[key])
    rows = rows.withColumns(typed)
    found = _reasons(shape)
    kept = [c for c in [*POSITIONS, "commit_lsn"] if c in rows.columns]
    return rows.select(*kept, *typed, F.coalesce(*found).alias("unfit"),
                       F.array_compact(F.array(*found)).alias("reasons"))


def _decoded(kind: Column, text: Column, data_type: T.DataType) -> Column:
    value = F.when(kind == "t", decode_text(text, data_type))
    if isinstance(data_type, (T.BinaryType, T.StringType)):
        value = value.when(kind == "b", decode_binary(text, data_type))
    return value


def _reasons(shape: TableShape) -> list[Column]:
    """One reason or NULL per column, and those that concern the whole row."""
    row = F.col("kind").isin("insert", "update", "delete")
    deleted = F.col("kind") == "delete"
    found = []
    for name in shape.types:
        kind = F.coalesce(F.col(f"_t_{name}.f"), F.lit("n"))
        lost = F.col(name).isNull() & F.col(f"_t_{name}.v").isNotNull()
        reason = F.when(~row, None).when(~kind.isin("n", "t", "b", "u"), f"bad_kind:{name}")
        reason = reason.when(lost, f"bad_value:{name}")
        if name in shape.keys:
            reason = reason.when(kind.isin("n", "u"), f"no_key:{name}")
        elif name in shape.required:
            reason = reason.when(~deleted & (kind == "n"), f"not_null:{name}")
        found.append(reason)
    found.append(F.when(row & F.col("new_cols").isNotNull() & (F.size("new_cols") != F.col("width")),
                        F.lit("tuple_width")))
    return found


def fit(decoded: DataFrame, shape: TableShape | None = None) -> DataFrame:
    """The rows that can be used. With a ``shape`` a row is used that has bad values only where it
    could be NULL: they are NULL then."""
    usable = F.col("unfit").isNull()
    if shape is not None:
        needed = [f"bad_{what}:{c}" for c in {*shape.keys, *shape.required} for what in ("value", "kind")]
        usable = usable | F.forall("reasons", lambda r: r.startswith("bad_") & ~r.isin(needed))
    return decoded.where(usable).drop("unfit", "reasons")


def quarantine(decoded: DataFrame) -> DataFrame:
    """Unfit rows with their reasons."""
    kept = [c for c in [*POSITIONS, "commit_lsn"] if c in decoded.columns]
    return decoded.where("unfit IS NOT NULL").select(*kept, "reasons")


def require_fit(decoded: DataFrame) -> DataFrame:
    """Strict mode: the rows, or an error if one of them is unfit."""
    first = quarantine(decoded).head()
    if first is not None:
        raise ValueError(f"undecodable change at lsn {first.lsn}: {', '.join(first.reasons)}")
    return fit(decoded)


def not_null_violations(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows with a NULL in a NOT NULL column, and those columns."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return df.withColumn("missing", missing).where(F.size("missing") > 0)
