"""Applying changes: current state, history, key changes, truncates.

Input is a committed log: key columns, value columns, ``kind``, ``commit_lsn, lsn, seq``, and
``<column>_f`` (the tuple kind) for every column that an update may leave unchanged.

A kept state may have ``<column>_at`` besides: where the value of such a column was set, if not
where the row was (``UNSET`` if nothing is known to have set it). With it, and with the rows of
deleted keys, changes can be applied in any order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelake.functions.lsn import ORDER, position
from changelake.functions.ordering import HOT_ROWS, bisect, neighbour
from changelake.session import fits, freeze, sized


POSITION = "STRUCT<commit_lsn: BIGINT, lsn: BIGINT, seq: INT>"
UNSET = (-1, -1, -1)
# The same for a live row's value in the fold that found it missing; the next one makes it UNSET.
MISSING = (-2, -1, -1)


def flag(column: str) -> str:
    return f"{column}_f"


def set_at(column: str) -> str:
    return f"{column}_at"


def unset(place: tuple[int, int, int] = UNSET) -> Column:
    return F.struct(*(F.lit(n).alias(c) for n, c in zip(place, ORDER))).cast(POSITION)


def _set_where(log: DataFrame, column: str) -> Column:
    """Where a row says that the column's value was set; NULL if it leaves it unchanged. Rows from
    before the column could come unchanged have no flag, and set it. Rows of a version that lacks
    the column (flag ``a``) count as before all that have it."""
    kind = F.coalesce(F.col(flag(column)), F.lit("t"))
    own = F.when(kind == "a", unset()).when(kind != "u", position())
    return F.coalesce(F.col(set_at(column)), own) if set_at(column) in log.columns else own


def latest(log: DataFrame, keys: Sequence[str], columns: Sequence[str],
           carried: Sequence[str] = ()) -> DataFrame:
    """Newest version per key, deletes included.

    All columns that always come with the row travel in one struct; a ``carried`` column has
    its own, taken from the newest change that set it. Both are partial aggregates, so the
    versions of a hot key shrink to one row per input partition before the shuffle.
    """
    order = position()
    plain = [c for c in columns if c not in carried]
    row = F.max_by(F.struct("kind", *ORDER, *plain), order).alias("_row")
    known = [F.max_by(F.struct(F.col(c).alias("v"), _set_where(log, c).alias("at")), _set_where(log, c)).alias(f"_{c}")
             for c in carried]
    return log.groupBy(*keys).agg(row, *known)


def live_rows(newest: DataFrame, keys: Sequence[str], columns: Sequence[str],
              carried: Sequence[str] = (), positions: bool = False) -> DataFrame:
    picked = [(F.col(f"_{c}.v") if c in carried else F.col(f"_row.{c}")).alias(c) for c in columns]
    extra = [F.col(f"_row.{c}") for c in ORDER] if positions else []
    return newest.where("_row.kind <> 'delete'").select(*keys, *picked, *extra)


def kept_rows(newest: DataFrame, keys: Sequence[str], columns: Sequence[str],
              carried: Sequence[str] = (), marked: bool = False) -> DataFrame:
    """Newest versions as a state to keep: deleted keys too, and where each value was set. What ``missing``
    lists can be ``marked``: it counts as set at ``MISSING``, below ``UNSET``."""
    row = F.struct(*(F.col(f"_row.{c}") for c in ORDER))
    picked = [(F.col(f"_{c}.v") if c in carried else F.col(f"_row.{c}")).alias(c) for c in columns]
    live = F.lit(marked) & (F.col("_row.kind") != "delete")
    places = [F.when(F.col(f"_{c}").isNull(), F.when(live, unset(MISSING)).otherwise(unset())).when(F.col(f"_{c}.at") != row, F.col(f"_{c}.at"))
              .alias(set_at(c)) for c in carried]
    kind = F.when(F.col("_row.kind") == "delete", "delete").otherwise("insert").alias("kind")
    return newest.select(*keys, *picked, *(F.col(f"_row.{c}") for c in ORDER), kind, *places)


def current_state(log: DataFrame, keys: Sequence[str], columns: Sequence[str],
                  carried: Sequence[str] = (), positions: bool = False) -> DataFrame:
    """Live rows. A column never set since the feed began is NULL; see ``unresolved``."""
    return live_rows(latest(log, keys, columns, carried), keys, columns, carried, positions)


def missing(newest: DataFrame, keys: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Live keys with a column that every change left unchanged, and those columns."""
    lost = F.array_compact(F.array(*[F.when(F.col(f"_{c}").isNull(), F.lit(c)) for c in carried]))
    return newest.where("_row.kind <> 'delete'").select(
        *keys, lost.alias("missing")).where(F.size("missing") > 0)


def marked_missing(kept: DataFrame, keys: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """The same from a state in which they are marked."""
    lost = F.array_compact(F.array(*[F.when(F.col(set_at(c)) == unset(MISSING), F.lit(c)) for c in carried]))
    return kept.select(*keys, lost.alias("missing")).where(F.size("missing") > 0)


def without_marks(kept: DataFrame, carried: Sequence[str]) -> DataFrame:
    return kept.withColumns({
        set_at(c): F.when(F.col(set_at(c)) == unset(MISSING), unset()).otherwise(F.col(set_at(c))) for c in carried})


def unresolved(log: DataFrame, keys: Sequence[str], columns: Sequence[str],
               carried: Sequence[str]) -> DataFrame:
    return missing(latest(log, keys, columns, carried), keys, carried)


def state_as_of(log: DataFrame, lsn: int, keys: Sequence[str], columns: Sequence[str],
                carried: Sequence[str] = ()) -> DataFrame:
    """State after the last transaction committed at or before ``lsn``."""
    return current_state(log.where(F.col("commit_lsn") <= lsn), keys, columns, carried)


def as_changes(state: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """State rows (with positions) as the changes that made them; every column is known."""
    kind = {} if "kind" in state.columns else {"kind": F.lit("insert")}
    return state.withColumns({**kind, **{flag(c): F.lit("t") for c in carried}})


def collapse(changes: DataFrame, keys: Sequence[str], columns: Sequence[str],
             carried: Sequence[str] = ()) -> DataFrame:
    """All changes of a key as one: the newest kind and position, and the newest known values.

    Applying the result gives the same state as applying the changes one by one.
    """
    newest = latest(changes, keys, columns, carried)
    cells = []
    for c in columns:
        cells.append((F.col(f"_{c}.v") if c in carried else F.col(f"_row.{c}")).alias(c))
        if c in carried:
            cells.append(F.when(F.col(f"_{c}").isNull(), "u").otherwise("t").alias(flag(c)))
            cells.append(F.col(f"_{c}.at").alias(set_at(c)))
    return newest.select(*keys, "_row.kind", *[f"_row.{c}" for c in ORDER], *cells)


def apply_changes(base: DataFrame, changes: DataFrame, keys: Sequence[str],
                  columns: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """State after ``changes`` on top of ``base`` (a state with positions)."""
    both = as_changes(base, carried).unionByName(changes, allowMissingColumns=True)
    return current_state(both, keys, columns, carried, positions=True)


def explode_key_change(changes: DataFrame, keys: Sequence[str], old_prefix: str = "old_",
                       origin: str | None = None, moving: bool = True) -> DataFrame:
    """An update that moves a row becomes a delete of the old key and an upsert of the new.

    ``origin`` names a column for the old key, which the upserts get. Without keys no row can move, nor
    if the caller knows that no update sends an old key (not ``moving``).
    """
    if not keys:
        return changes
    old = [F.col(old_prefix + k) for k in keys]
    moved = (F.col("kind") == "update") & old[0].isNotNull() & ~_same(old, keys)
    others = [c for c in changes.columns if c != "kind" and c not in keys]
    place = F.struct(*[o.alias(k) for o, k in zip(old, keys)])
    upsert = [F.col("kind"), *keys, *([F.when(moved, place).alias(origin)] if origin else [])]
    delete = [F.lit("delete").alias("kind"), *[o.alias(k) for o, k in zip(old, keys)],
              *([F.when(F.lit(False), place).alias(origin)] if origin else [])]
    # The delete sets every column, as what the old key had is gone.
    rest = [c for c in others if c not in {old_prefix + k for k in keys}]
    if moving:
        parts = F.when(moved, F.array(F.struct(*delete), F.struct(*upsert))).otherwise(F.array(F.struct(*upsert)))
        split = changes.select(*others, F.explode(parts).alias("_part")).select("_part.*", *rest)
    else:
        split = changes.select(*upsert, *rest)
    gone, flags = F.col("kind") == "delete", [c for c in others if c.endswith("_f") and c[:-2] in others]
    return split.withColumns({c[:-2]: F.when(~gone, F.col(c[:-2])) for c in flags} | {
        c: F.when(gone, "n").otherwise(F.col(c)) for c in flags})


def _same(old: Sequence[Column], keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for o, k in zip(old, keys):
        same = same & o.eqNullSafe(F.col(k))
    return same


def after_truncate(log: DataFrame, table: str = "relation_id") -> DataFrame:
    """Rows later than the last truncate of their table. One position per table is joined."""
    last = (log.where("kind = 'truncate'").groupBy(table)
            .agg(F.max(position()).alias("_truncated")))
    return (log.where("kind <> 'truncate'").join(sized(last), table, "left")
            .where(F.col("_truncated").isNull() | (position() > F.col("_truncated")))
            .drop("_truncated"))


def history(log: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every version with the log position of its successor (``valid_to``, NULL if none)."""
    versions = log.withColumn("valid_from", F.col("lsn"))
    return neighbour(versions, keys, ORDER, "valid_from", "valid_to", hot_rows=hot_rows)


def inherit(log: DataFrame, keys: Sequence[str], carried: Sequence[str], origin: str,
            base: DataFrame | None = None) -> DataFrame:
    """Values that moves leave unchanged, taken from the keys that the rows moved from.

    ``log`` comes from ``explode_key_change`` with ``origin``. A key's changes fall into stretches
    between the moves that leave it, and each stretch has the newest value of each column, or the move
    into it that left the column open. Such moves form chains; every round lets each one point
    twice as far, so a chain of n moves takes log n joins. A chain that begins before the log ends
    at a key of ``base``: a state (keys, ``kind``, positions, values and where they were set), which is
    met once.

    Returns the log with these values filled in, and ``lost``: the columns of a move that have no
    value anywhere, which become NULL (an array, NULL for all other rows).
    """
    opened = reduce(lambda a, c: a | (F.col(flag(c)) == "u"), carried, F.lit(False))
    is_open = F.col(origin).isNotNull() & opened
    log = log.withColumn("_p", position())
    key = F.struct(*keys)
    moves = freeze(log.where(is_open).select("_p", F.col(origin).alias("_key"), *map(flag, carried)))
    left = freeze(moves.groupBy("_key").agg(F.sort_array(F.collect_set("_p")).alias("_left")))
    longest = left.agg(F.coalesce(F.max(F.size("_left")), F.lit(0))).first()[0]
    part = bisect(F.col("_left"), F.col("_p"), longest)
    rows = log.withColumn("_key", key).join(left, "_key").withColumn("_part", part)
    entries = []
    for c in carried:
        via = F.when(F.col(origin).isNotNull() & (F.col(flag(c)) == "u"), F.col("_p"))
        known = F.when(~F.col(flag(c)).isin("u", "a") | via.isNotNull(), F.col("_p"))
        entries.append(F.max_by(F.struct(F.col(c).alias("v"), via.alias("via")), known).alias(f"_{c}"))
    parts = freeze(rows.groupBy("_key", "_part").agg(*entries))
    placed = moves.join(left, "_key").withColumn("_part", part - 1).join(parts, ["_key", "_part"], "left")
    wanted = F.array_compact(F.array(*(F.when(F.col(flag(c)) == "u", F.struct(
        F.lit(c).alias("column"), F.col(f"_{c}.via").alias("via"))) for c in carried)))
    links = placed.select("_p", "_key", "_part", F.explode(wanted).alias("_w")).select("_p", "_key", "_part", "_w.*")
    while True:
        links = freeze(links)
        if links.where("via is not null").isEmpty():
            break
        further = links.select(F.col("_p").alias("via"), "column", F.col("_key").alias("_k"),
                               F.col("_part").alias("_q"), F.col("via").alias("_v"))
        jumped = links.where("via is not null").join(further, ["via", "column"]).select(
            "_p", F.col("_k").alias("_key"), F.col("_q").alias("_part"), "column", F.col("_v").alias("via"))
        links = links.where("via is null").unionByName(jumped)
    found = links.join(parts, ["_key", "_part"], "left")
    if base is not None:
        roots = F.broadcast if fits(left) else (lambda df: df)
        state = base.withColumn("_key", key).join(roots(links.select("_key").distinct()), "_key", "left_semi").select(
            "_key", *(F.when(F.col("kind") != "delete", F.struct(F.col(c).alias("v"), F.coalesce(
                F.col(set_at(c)), position()).alias("at"))).alias(f"_base_{c}") for c in carried))
        found = found.join(state, "_key", "left")
    cells = []
    for c in carried:
        value = F.when(F.col(f"_{c}").isNotNull(), F.struct(F.col(f"_{c}.v").alias("v")))
        if base is not None:
            at = F.col(f"_base_{c}.at")
            value = F.coalesce(value, F.when((at < F.col("_p")) & (at > unset()), F.struct(F.col(f"_base_{c}.v").alias("v"))))
        cells.append(F.first(F.when(F.col("column") == c, value), ignorenulls=True).alias(f"_{c}"))
    resolved = freeze(found.groupBy("_p").agg(*cells))
    filled = log.where(is_open).join(resolved, "_p", "left")
    lost = F.array_compact(F.array(*(F.when((F.col(flag(c)) == "u") & F.col(f"_{c}").isNull(), F.lit(c)) for c in carried)))
    filled = filled.withColumn("lost", F.when(F.size(lost) > 0, lost)).withColumns({
        c: F.when(F.col(flag(c)) == "u", F.col(f"_{c}.v")).otherwise(F.col(c)) for c in carried}).withColumns({
            flag(c): F.when(F.col(flag(c)) != "u", F.col(flag(c))).when(F.col(f"_{c}").isNull(), "n").otherwise("t")
            for c in carried})
    rest = log.where(~F.coalesce(is_open, F.lit(False))).withColumn("lost", F.lit(None).cast("array<string>"))
    return rest.unionByName(filled.select(*rest.columns)).drop("_p", origin)
