"""The replication job: a stream of change messages into mirrored tables.

Per micro-batch: transactions that ended meet their rows from this and earlier batches; rows of
open transactions wait below ``_feed/pending``; released rows are decoded and published per
table. All paths of a batch carry its number: repeated after a failure, it replaces what it wrote,
and leaves alone what it had published.
"""

from __future__ import annotations

import datetime
import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from changelake.operators import compaction, decode, monitor, transactions
from changelake.operators.maintenance import RUNS
from changelake.operators.relations import (
    Sizes, TableShape, bind_relation, relation_versions, unknown_relation)
from changelake.session import counted, few_listing_tasks, freeze, sized, step
from changelake.sources.envelope import ABORTS, CHANGES, rows_only
from changelake.sources.logs import exists, read_log, remove, write_log
from changelake.streaming.table import MirroredTable

STEP = 1000  # snapshot ids of a batch and of the maintenance that follows it
BATCHES = "batch_id BIGINT, messages MAP<STRING, BIGINT>, last_lsn BIGINT, finished_at TIMESTAMP"
TRIMS = "trim BIGINT, first_batch BIGINT"
BASE = "table_name STRING, part STRING, low BIGINT, rows BIGINT"
FAILURES = "table_name STRING, batch BIGINT, error STRING, rows BIGINT, failed_at TIMESTAMP"
RECOVERIES = "table_name STRING, through BIGINT"
ERRORS = """table_name STRING, lsn BIGINT, seq INT, xid BIGINT, kind STRING, relation_id BIGINT,
            reasons ARRAY<STRING>, batch BIGINT"""


def full_name() -> Column:
    """Name of the relation a row is bound to; NULL if there is none."""
    return F.concat(F.col("relation.namespace"), F.lit("."), F.col("relation.name"))


class Mirror:
    """Configured tables below one root.

    States are brought up to date every ``fold_every`` batches or, with ``fold_share``, when the log
    that is not folded yet reaches that share of a table's state. ``workers`` tables are written side
    by side, each in a scheduler pool of its own (pools share the cluster if the scheduler is FAIR).
    With ``keep_going`` a table that fails stays as it was and is listed, the others go on, and its
    changes are tried again with the next batch; otherwise the batch fails.
    """

    def __init__(self, spark: SparkSession, root: str, tables: Iterable[MirroredTable],
                 fold_every: int = 1, compact_every: int = 0, pending_buckets: int = 64,
                 fold_share: float | None = None, workers: int = 4, keep_going: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = {t.full_name: t for t in tables}
        self.fold_every, self.compact_every = fold_every, compact_every
        self.pending_buckets, self.fold_share = pending_buckets, fold_share
        self.workers, self.keep_going = workers, keep_going
        self._described: tuple[DataFrame, Sizes, dict[str, TableShape]] | None = None

    def _feed(self, name: str) -> str:
        return f"{self.root}/_feed/{name}"

    def start(self, changes: DataFrame, interval: str | None = None):
        """Apply everything the source holds now, then stop; or go on, a batch every ``interval``.

        Progress is in the checkpoint.
        """
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return (changes.writeStream.foreachBatch(self.apply_batch)
                .option("checkpointLocation", self._feed("checkpoint"))
                .trigger(**trigger).start())

    def run(self, changes: DataFrame) -> None:
        query = self.start(changes)
        query.awaitTermination()
        if query.exception():
            raise query.exception()

    def apply_batch(self, batch: DataFrame, batch_id: int) -> None:
        done = self._feed(f"batches/batch={batch_id}")
        if exists(self.spark, f"{done}/_SUCCESS"):
            return  # the stream stopped after this batch was finished and before it noted so
        steps: list[str] = []
        try:
            # Read once, whatever the source; steps are files, as rows that executors keep would fill their memory.
            batch = self._step(batch, "arrived", steps)
            few_listing_tasks(self.spark)
            once = transactions.distinct_messages(batch)
            if once is not batch:
                batch = self._step(once, "once", steps)
            raw = F.when(F.col("kind") == "malformed", F.col("kind")).alias("raw")
            counts = batch.groupBy(monitor.label().alias("kind"), raw).agg(
                F.count(F.lit(1)).alias("n"), F.max("lsn").alias("lsn")).collect()
            kinds = {r.kind for r in counts}
            if "relation" in kinds:
                write_log(batch.where("kind = 'relation'"), self._feed(f"relations/batch={batch_id}"))
                self._described = None
            if "malformed" in {r.raw for r in counts}:
                bad = batch.where("kind = 'malformed'")
                self._errors(bad.withColumn("reasons", F.concat(
                    F.array(F.lit("malformed")), F.transform("new_cols", lambda c: c["v"]))), None, batch_id, "malformed")
            ends = self._step(transactions.markers(batch), "ends", steps)
            left_out = self._publish(self._released(batch, ends, batch_id, "stream_abort" in kinds, steps), batch_id)
        finally:
            for path in steps:
                remove(self.spark, path)
        messages: dict[str, int] = {}
        for r in counts:
            messages[r.kind] = messages.get(r.kind, 0) + r.n
        messages |= {f"not selected: {name}": n for name, n in left_out.items()}
        row = (batch_id, messages, max((r.lsn for r in counts if r.raw is None), default=None),
               datetime.datetime.now(datetime.timezone.utc))
        write_log(self.spark.createDataFrame([row], BATCHES).coalesce(1), done)
        if self.compact_every and (batch_id + 1) % self.compact_every == 0:
            self.compact(batch_id)
            self.trim_pending()

    def _step(self, df: DataFrame, name: str, steps: list[str]) -> DataFrame:
        """``df`` as files that go when the batch ends; their place is added to ``steps``."""
        found = step(df, name, self.spark)
        steps.append(found.stored_at)
        return found

    def compact(self, run: int) -> None:
        """Merge small log files of every table, and keep the totals of the run."""
        start = time.time()
        stats = [s for s in (t.compact() for t in self.tables.values()) if s is not None]
        if stats:
            merged = reduce(DataFrame.unionByName, stats)
            totals = compaction.run_totals(merged, len(self.tables), time.time() - start)
            write_log(totals.coalesce(1), self._feed(f"compactions/run={run}"))

    def compactions(self) -> DataFrame:
        return read_log(self.spark, self._feed("compactions"), RUNS)

    def versions(self, batch_id: int | None = None) -> DataFrame:
        """Relation versions known up to a batch."""
        messages = read_log(self.spark, self._feed("relations"), CHANGES + ", batch BIGINT")
        if batch_id is not None:
            messages = messages.where(F.col("batch") <= batch_id)
        return relation_versions(transactions.deduplicate(messages))

    def _shapes(self, batch_id: int | None) -> tuple[DataFrame, Sizes, dict[str, TableShape]]:
        """Relation versions, how many they are, and the shapes of the configured tables.

        They are kept until the next relation message.
        """
        if self._described is None:
            versions = self.versions(batch_id)
            named = versions.select(full_name().alias("n")).where(
                F.col("n").isin(*self.tables)).distinct().collect()
            shapes = {t.full_name: TableShape.of(versions, t.namespace, t.name, t.required)
                      for t in (self.tables[r.n] for r in named)}
            self._described = versions, Sizes.of(versions), shapes
        return self._described

    def _released(self, batch: DataFrame, ends: DataFrame, batch_id: int, aborts: bool,
                  steps: list[str]) -> DataFrame:
        """Committed rows of the transactions that end in this batch; the others are put by.

        The batch's rows meet the ends once, for both. Places of what is stored are added to ``steps``.
        """
        number = F.pmod("xid", F.lit(self.pending_buckets)).cast("int").alias("xb")
        place, ends = self._put_by(batch_id), counted(ends)
        new_ends = ends
        # Rows that land after their marker belong to a transaction that has ended.
        gone = self._kept(place, "ended").where(F.col("batch") < batch_id).select("xid", "commit_lsn", "aborted")
        behind = (gone.join(rows_only(batch).select("xid").distinct().hint("merge"), "xid", "left_semi")
                  .join(ends.select("xid"), "xid", "left_anti").dropDuplicates(["xid"]))
        if not behind.isEmpty():
            ends = counted(ends.unionByName(self._step(behind, "behind", steps)))
        touched = [r.xb for r in ends.select(number).distinct().collect()]

        def earlier(name: str) -> DataFrame:
            return self._kept(place, name).where(
                (F.col("batch") < batch_id) & F.col("xb").isin(touched)).drop("batch", "xb")

        undone = transactions.aborted_parts(batch) if aborts else self._no_parts()
        before = transactions.aborted_parts(earlier("parts"))
        if not before.isEmpty():
            undone = self._step(undone.unionByName(before).distinct(), "undone", steps)
        fates = ends.select("xid", "commit_lsn", "aborted", F.lit(True).alias("_ended"))
        judged = self._step(transactions.outside(rows_only(batch), undone).join(fates, "xid", "left"), "judged", steps)
        open_rows = judged.where("_ended IS NULL").drop(*fates.columns[1:])
        write_log(open_rows.select("*", number), f"{place}/pending/batch={batch_id}", "xb")
        write_log(new_ends.select("xid", "commit_lsn", "aborted"), f"{place}/ended/batch={batch_id}")
        if aborts:
            parts = batch.where("kind = 'stream_abort' AND sub_xid <> xid")
            write_log(parts.select("*", number), f"{place}/parts/batch={batch_id}", "xb")
        waited = earlier("pending").join(ends.select("xid"), "xid", "left_semi")
        if not waited.isEmpty():
            waited = self._step(transactions.outside(waited, undone).join(fates, "xid"), "waited", steps)
            # A row put by earlier may have been delivered again now.
            both = judged.where("_ended").unionByName(waited)
            judged = transactions.distinct_messages(both)
            if judged is not both:
                judged = self._step(judged, "released", steps)
        return judged.where("_ended AND NOT aborted").drop("aborted", "_ended")

    def _no_parts(self) -> DataFrame:
        return self.spark.createDataFrame([], "xid BIGINT, sub_xid BIGINT")

    def _put_by(self, batch_id: int) -> str:
        """Where a batch finds and leaves rows of open transactions: a new place after each trim.

        A trim serves the batches after it; one that is repeated goes back to the place before.
        """
        if not exists(self.spark, self._feed("trims")):
            return self._feed("open-0")
        trims = read_log(self.spark, self._feed("trims"), TRIMS).where(F.col("first_batch") <= batch_id)
        last = trims.agg(F.max("trim")).first()[0] or 0
        return self._feed(f"open-{last}")

    def _kept(self, place: str, name: str) -> DataFrame:
        schema = ("xid BIGINT, commit_lsn BIGINT, aborted BOOLEAN, batch BIGINT" if name == "ended"
                  else CHANGES + ", batch BIGINT, xb INT")
        return read_log(self.spark, f"{place}/{name}", schema)

    def _next_batch(self) -> int:
        done = self.last_batch()
        return 0 if done is None else done + 1

    def pending(self) -> DataFrame:
        """Rows of transactions that no finished batch has ended, without parts rolled back."""
        upto = self._next_batch()
        place, before = self._put_by(upto), F.col("batch") < upto
        ended = self._kept(place, "ended").where(before).select("xid").distinct()
        dropped = self._kept(place, "parts").where(before).select("xid", "sub_xid").distinct()
        rows = self._kept(place, "pending").where(before).drop("xb")
        rows = rows.join(sized(ended), "xid", "left_anti")
        return transactions.deduplicate(transactions.outside(rows, dropped))

    def trim_pending(self) -> None:
        """Write what is still open to a new place, without transactions that ended since."""
        first = self._next_batch()
        place = self._put_by(first)
        last = int(place.rsplit("-", 1)[1])
        before = F.col("batch") < first
        number = F.pmod("xid", F.lit(self.pending_buckets)).cast("int").alias("xb")
        ended = sized(self._kept(place, "ended").where(before).select("xid").distinct())
        parts = self._kept(place, "parts").where(before).drop("xb").join(ended, "xid", "left_anti")
        for name, rows in (("pending", self.pending()), ("parts", parts)):
            write_log(rows.drop("batch").select("*", number),
                      self._feed(f"open-{last + 1}/{name}/batch={first - 1}"), "xb")
        write_log(self.spark.createDataFrame([(last + 1, first)], TRIMS).coalesce(1),
                  self._feed(f"trims/at={last + 1}"))
        # Only the last batch can be repeated, and it needs at most the place before this one.
        remove(self.spark, self._feed(f"open-{last - 1}"))

    def _publish(self, released: DataFrame, batch_id: int) -> dict[str, int]:
        """Publishes the rows of configured tables; gives the numbers of rows of all others."""
        versions, sizes, shapes = self._shapes(batch_id)
        # One pass tells which tables have rows; the others cost nothing more.
        opened = ((F.col("kind") == "update") & F.col("old_cols").isNotNull()
                  & F.exists("new_cols", lambda c: c["f"] == "u"))
        renamed = (F.col("kind") == "update") & F.col("old_cols").isNotNull()
        marked = released.select("relation_id", "lsn", "seq", "commit_lsn", opened.alias("moves"), renamed.alias("moving"))
        found = {r.n: r for r in bind_relation(marked, versions, True, sizes).groupBy(full_name().alias("n")).agg(
            F.count(F.lit(1)).alias("rows"), F.min("commit_lsn").alias("low"), F.max("moves").alias("moves"),
            F.max("moving").alias("moving")).collect()}
        if None in found:
            unknown = unknown_relation(released, versions, sizes)
            self._errors(unknown.withColumn("reasons", F.array(F.lit("unknown_relation"))), None, batch_id)
        waiting = self._waiting(batch_id)

        def publish(name: str) -> None:
            context, own, row = self.spark.sparkContext, released, found.get(name)
            context.setLocalProperty("spark.scheduler.pool", name)
            if name in waiting:
                again = self._failed().where((F.col("table_name") == name) & (F.col("batch") > waiting[name])
                                             & (F.col("batch") < batch_id))
                own = own.unionByName(again.select(*own.columns))
                row = None
            self._publish_table(name, own, row, versions, sizes, shapes[name], batch_id)
            if name in waiting:
                write_log(self.spark.createDataFrame([(name, batch_id)], RECOVERIES).coalesce(1),
                          self._feed(f"recoveries/batch={batch_id}/part={name}"))

        names = sorted(({n for n in found if n in self.tables} | set(waiting)) & set(shapes))
        failed: dict[str, Exception] = {}
        with ThreadPoolExecutor(max(1, min(self.workers, len(names) or 1))) as pool:
            for name, result in [(name, pool.submit(publish, name)) for name in names]:
                error = result.exception()
                if error is not None:
                    failed[name] = error
        for name, error in failed.items():
            if not self.keep_going:
                raise error
            self._put_aside(name, error, released, versions, sizes, batch_id)
        return {n: r.rows for n, r in found.items() if n is not None and n not in self.tables}

    def _publish_table(self, name: str, released: DataFrame, row: Row | None, versions: DataFrame, sizes: Sizes,
                       shape: TableShape, batch_id: int) -> None:
        """Decode and publish a table's rows. ``row`` has what is known of them beforehand."""
        table, snapshot_id = self.tables[name], (batch_id + 1) * STEP
        fold = (batch_id + 1) % self.fold_every == 0 if self.fold_share is None else float(self.fold_share)
        decoded = decode.to_columns(decode.bind(released, versions, shape, sizes), shape)
        unfit = Observation()
        seen = decoded.observe(unfit, F.count("unfit").alias("rows"))
        rows = (decode.require_fit(seen) if table.bad_values == "fail"
                else decode.fit(seen, shape if table.bad_values == "cell" else None))
        arrived, late = table.arrivals(rows, snapshot_id, row.low if row else None)
        rows = table.append(arrived, shape, snapshot_id, fold, *((row.moves, row.moving) if row else (True, True)))
        # Without a write there is no count; the job may have stopped before the errors.
        if rows is None or unfit.get["rows"]:
            self._errors(decode.quarantine(decoded), name, batch_id)
        if late is not None:
            self._errors(late.withColumn("reasons", F.array(F.lit("late_commit"))), name, batch_id, f"{name}-late")

    def _put_aside(self, name: str, error: Exception, released: DataFrame, versions: DataFrame, sizes: Sizes,
                   batch_id: int) -> None:
        """Keep the changes of a table that failed, for the batches to come."""
        rows = bind_relation(released, versions, False, sizes).where(full_name() == name)
        path = self._feed(f"failed/batch={batch_id}/part={name}")
        write_log(rows.select(F.lit(name).alias("table_name"), *released.columns), path)
        row = (name, batch_id, f"{type(error).__name__}: {error}"[:1000], self.spark.read.parquet(path).count(),
               datetime.datetime.now(datetime.timezone.utc))
        write_log(self.spark.createDataFrame([row], FAILURES).coalesce(1), self._feed(f"failures/at={batch_id}/part={name}"))

    def _failed(self) -> DataFrame:
        return read_log(self.spark, self._feed("failed"), f"table_name STRING, {CHANGES}, commit_lsn BIGINT, batch BIGINT")

    def failures(self) -> DataFrame:
        """Tables that failed, by batch, with the reason."""
        return read_log(self.spark, self._feed("failures"), FAILURES)

    def _waiting(self, batch_id: int) -> dict[str, int]:
        """Tables with changes put aside by earlier batches, and the batch up to which they were made good."""
        if not self.keep_going:
            return {}
        last = read_log(self.spark, self._feed("recoveries"), RECOVERIES).where(F.col("through") < batch_id).groupBy(
            "table_name").agg(F.max("through").alias("through"))
        known = self.failures().where(F.col("batch") < batch_id).join(last, "table_name", "left").where(
            F.col("batch") > F.coalesce("through", F.lit(-1)))
        return {r.table_name: r.through for r in known.groupBy("table_name").agg(
            F.coalesce(F.max("through"), F.lit(-1)).alias("through")).collect()}

    def load_base(self, full_name: str, rows: DataFrame, low: int, part: str, keys: Iterable[str] = ()) -> int:
        """Load a part of a table as it was copied from the source, while the feed goes on.

        ``rows`` (typed columns) were read at or after position ``low``; the feed must hold everything
        from there on. Its changes go before the copied rows, whether they were applied earlier or come
        later. A part that was loaded is not loaded again; returns the number of rows. ``keys`` are
        needed only before the first description of the table.
        """
        done = self._feed(f"base/at={full_name}-{part}")
        if exists(self.spark, f"{done}/_SUCCESS"):
            return 0
        table = self.tables[full_name]
        shape = self._shapes(None)[2].get(full_name)
        if shape is None:
            shape = TableShape.from_schema(table.namespace, table.name, rows.schema, keys)
        at, batch = table.snapshot(), self.last_batch()
        if at and table.horizon is not None and low < at.max_lsn - table.horizon:
            raise ValueError(f"position {low} is below the horizon of {full_name}; copy the rows again")
        first = 0 if batch is None else (batch + 1) * STEP
        given = {column: F.col(name) for name, column in shape.visible.items()}
        typed = rows.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in shape.types.items()))
        loaded = table.load(typed, shape, low, max(first, at.snapshot_id if at else 0) + 1)
        write_log(self.spark.createDataFrame([(full_name, part, low, loaded)], BASE).coalesce(1), done)
        return loaded

    def _errors(self, rows: DataFrame, name: str | None, batch_id: int, part: str | None = None) -> None:
        rows = rows.select(F.lit(name).cast("string").alias("table_name"), "lsn", "seq", "xid", "kind",
                           "relation_id", "reasons")
        write_log(rows, self._feed(f"errors/batch={batch_id}/part={part or name or 'unknown'}"))

    # --- reading ---------------------------------------------------------------------------

    def last_batch(self) -> int | None:
        return read_log(self.spark, self._feed("batches"), BATCHES).agg(F.max("batch_id")).first()[0]

    def snapshot_bound(self) -> int:
        """Snapshots up to here belong to finished batches: the same cut for all tables."""
        done = self.last_batch()
        return STEP - 1 if done is None else (done + 2) * STEP - 1

    def read(self, full_name: str, as_of: int | None = None) -> DataFrame | None:
        """A table as the last finished batch left it, or at an earlier snapshot."""
        bound = self.snapshot_bound()
        return self.tables[full_name].read(bound if as_of is None else min(as_of, bound))

    def register(self) -> list[str]:
        """A view per mirrored table: ``<schema>_<name>``, and the bare name where only one has it."""
        names = []
        bare = [t.name for t in self.tables.values()]
        for table in self.tables.values():
            df = self.read(table.full_name)
            if df is not None:
                names.append(f"{table.namespace}_{table.name}")
                if bare.count(table.name) == 1:
                    names.append(table.name)
                for name in names[-2:] if names[-1] == table.name else names[-1:]:
                    df.createOrReplaceTempView(name)
        return names

    def errors(self) -> DataFrame:
        return read_log(self.spark, self._feed("errors"), ERRORS)

    def batches(self) -> DataFrame:
        return read_log(self.spark, self._feed("batches"), BATCHES)

    def message_counts(self) -> DataFrame:
        """Messages by kind over all batches, from the counts taken as they went by."""
        return self.batches().select(F.explode("messages").alias("kind", "n")).groupBy("kind").agg(
            F.sum("n").alias("messages"))

    def lag(self) -> DataFrame:
        """Per table: distance from the newest message to the position it was applied to."""
        seen = self.batches().agg(F.max("last_lsn")).first()[0] or 0
        rows = [(t.full_name, seen, at.max_lsn if (at := t.snapshot()) else 0)
                for t in self.tables.values()]
        return self.spark.createDataFrame(
            rows, "table_name STRING, feed_lsn BIGINT, applied_lsn BIGINT").withColumn(
            "lag_bytes", F.greatest(F.col("feed_lsn") - F.col("applied_lsn"), F.lit(0)))

    def health(self, degraded_bytes: int, unhealthy_bytes: int) -> DataFrame:
        """Components in the form that ``status_rollup`` takes: storage and lag per table."""
        far = F.when(F.col("lag_bytes") >= unhealthy_bytes, "unhealthy").when(
            F.col("lag_bytes") >= degraded_bytes, "degraded").otherwise("healthy")
        lag = self.lag().select(
            F.concat(F.lit("replication:"), "table_name").alias("component"), far.alias("status"),
            F.create_map(F.lit("lag_bytes"), F.col("lag_bytes").cast("string")).alias("details"))
        parts = [lag]
        for table in self.tables.values():
            size = table.live().agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
            parts.append(size.select(
                F.lit(f"storage:{table.full_name}").alias("component"),
                F.when(F.col("files") > 0, "healthy").otherwise("degraded").alias("status"),
                F.create_map(F.lit("files"), F.col("files").cast("string"), F.lit("bytes"),
                             F.coalesce("bytes", F.lit(0)).cast("string")).alias("details")))
        return reduce(DataFrame.unionByName, parts).withColumn("checked_at", F.current_timestamp())
