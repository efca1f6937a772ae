"""What must not depend on the size of the tables: limits of Spark, and the share of one task."""

import pathlib
import re

from pyspark.sql import functions as F
from test_no_loss import feed
from test_stream import end, relation, row, t

from changelake import session
from changelake.operators import compaction, decode, state, transactions
from changelake.plans import sql_queries, table_queries  # noqa: F401
from changelake.plans.registry import QUERIES
from changelake.operators.relations import TableShape
from changelake.sources import inventory
from changelake.streaming.mirror import Mirror
from changelake.streaming.table import MirroredTable


def mirrored(spark, tmp_path, **options):
    return MirroredTable(spark, str(tmp_path), "public", "t", **options)


def changes(table, rows, snapshot_id, parts=2):
    rows = rows.selectExpr("id k", "hash(id) v").repartition(parts)
    shape = TableShape.from_schema("public", "t", rows.schema, ["k"])
    cells = {f"old_{k}": F.lit(None).cast("bigint") for k in shape.keys} | {
        f"{c}_f": F.lit("t") for c in shape.carried_values}
    table.append(rows.selectExpr("*", "'insert' kind", "1L relation_id", "1L xid", f"{snapshot_id}L + k commit_lsn",
                                 f"{snapshot_id}L + k lsn", "0 seq").withColumns(cells), shape, snapshot_id, moves=False)


def test_recursion_of_over_a_million_rows(spark, tmp_path):
    spark.range(600_000).selectExpr("id c_custkey", "24 c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert QUERIES["sql_recursive"](spark, str(tmp_path)).count() == 1_200_000


def test_each_group_of_a_rewrite_has_tasks_of_its_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "TASK_BYTES", 40_000, raising=False)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(60_000).selectExpr("id", "hash(id) h").repartition(12).write.parquet(source)
    plan = compaction.plan_by_count(inventory.file_inventory(spark, source), 4)
    least = {r.grp: -(-r.bytes // 40_000) for r in plan.groupBy("grp").agg(F.sum("length").alias("bytes")).collect()}
    written = compaction.rewrite(spark, plan, out).collect()
    assert {g: sum(w.grp == g for w in written) for g in least} == least
    tasks = [re.search(r"part-(\d+)", w.path)[1] for w in written]
    assert len(set(tasks)) == len(tasks)
    assert max(w.record_count for w in written) < 60_000 // len(written) * 1.2
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    assert rows.count() == 60_000 and rows.distinct().count() == 60_000


def test_small_files_are_written_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(table_queries, "TASK_ROWS", 1_000, raising=False)
    seen = []
    monkeypatch.setattr(table_queries.compaction, "rewrite", lambda spark, plan, out, **k: (
        seen.append(plan.count()), spark.range(0).write.parquet(out)))
    spark.range(40_000).write.parquet(f"{tmp_path}/lineitem.parquet")
    table_queries.compaction_rows_preserved(spark, str(tmp_path))
    assert seen == [40]


def test_files_of_orders_come_in_parts_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(table_queries, "parts_for", lambda df: 37, raising=False)
    spark.range(1000).selectExpr("id div 4 l_orderkey", "id % 4 l_linenumber", "if(id % 3 = 0, 'R', 'N') l_returnflag",
                                 "double(id) l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    files = table_queries._files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == 37
    assert files.count() == 1000 + 334
    placed = files.select("table_name", F.spark_partition_id().alias("p")).distinct()
    assert placed.count() == files.select("table_name").distinct().count()


def test_buckets_of_a_fold_have_tasks_of_their_own(spark, tmp_path):
    table = mirrored(spark, tmp_path, buckets=2)
    changes(table, spark.range(2_000), 1000)
    tasks = [re.search(r"part-(\d+)", e.path)[1] for e in table._entries() if e.area == "data"]
    assert len(tasks) == len(set(tasks)) == 2
    assert table.read().count() == 2_000


def test_neighbouring_slots_share_a_task(spark, tmp_path, monkeypatch):
    table = mirrored(spark, tmp_path, buckets=40, task_bytes=100)
    changes(table, spark.range(20_000), 1000)
    tasks = {re.search(r"part-(\d+)", e.path)[1] for e in table._entries() if e.area == "data"}
    assert len(tasks) <= 2 * spark.sparkContext.defaultParallelism
    assert sorted(r.k for r in table.read().collect()) == list(range(20_000))


def test_log_is_compacted_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "TASK_BYTES", 40_000, raising=False)
    table = mirrored(spark, tmp_path)
    for i in range(4):
        changes(table, spark.range(i * 5_000, i * 5_000 + 5_000), 1000 * (i + 1), 4)
    before = sum(e.bytes for e in table._entries() if e.area == "log")
    table.compact()
    files = [e for e in table._entries() if e.area == "archive"]
    assert len(files) >= before // 40_000 and max(e.bytes for e in files) < 80_000
    assert sum(e.record_count for e in files) == 20_000 and table.read_log().count() == 20_000
    large = {e.path for e in files if e.bytes >= 20_000}
    table.compact()
    assert large <= {e.path for e in table._entries()}


def test_only_repeated_messages_are_grouped_as_whole_rows(spark):
    once = spark.sql("select id lsn, 0 seq, array('x') cells from range(50)").cache()
    assert transactions.distinct_messages(once) is once
    twice = once.unionByName(once.where("lsn % 9 = 0")).unionByName(
        spark.sql("select cast(null as bigint) lsn, 0 seq, array('y') cells from range(3)")).cache()
    left = transactions.distinct_messages(twice)
    assert left.count() == 51 and left.distinct().count() == 51
    once.unpersist()
    twice.unpersist()


def test_rows_that_cannot_move_are_not_unfolded(spark):
    rows = spark.sql("""select id k, if(id % 3 = 0, 'delete', 'update') kind, id * 2L v, 't' v_f, cast(null as bigint) old_k
                        from range(30)""")
    whole, plain = state.explode_key_change(rows, ["k"]), state.explode_key_change(rows, ["k"], moving=False)
    assert "Generate" not in plain._jdf.queryExecution().toString()
    assert plain.columns == whole.columns and sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_missing_values_are_listed_from_what_a_fold_wrote(spark, tmp_path, monkeypatch):
    def unused(*args):
        raise AssertionError("the fold is computed again")

    monkeypatch.setattr(state, "missing", unused)
    table = mirrored(spark, tmp_path, buckets=2)
    rows = spark.sql("select id k, if(id % 2 = 0, 'x', null) v from range(8)")
    shape = TableShape("public", "t", [("k", 20, -1, True), ("v", 25, -1, False)])
    for at in (1, 2):
        table.append(rows.selectExpr(
            "*", "'update' kind", "1L relation_id", "1L xid", f"{100 * at}L + k commit_lsn", f"{100 * at}L + k lsn", "0 seq",
            "if(k % 2 = 0, 't', 'u') v_f", "cast(null as bigint) old_k"), shape, at, moves=False)
    found = table.errors().orderBy("key").collect()
    assert [(r.key, r.missing, r.snap) for r in found] == [(f'{{"k":{k}}}', ["v"], 1) for k in (1, 3, 5, 7)]
    assert {r.k: r.v for r in table.read().collect()} == {k: "x" if k % 2 == 0 else None for k in range(8)}


def test_decodes_are_compiled_in_any_session(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    rows = other.sql("select 1L lsn, 0 seq, 1L xid, 1L sub_xid, 'insert' kind, 1L relation_id, 2 width, array(0, 1) at, "
                     "array(named_struct('f', 't', 'v', '7')) new_cols, cast(null as array<struct<f: string, v: string>>) old_cols")
    shape = TableShape("public", "t", [("k", 20, -1, True), ("v", 25, -1, False)])
    assert decode.to_columns(rows, shape).select("k").first().k == 7
    assert int(other.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000


def persisted(spark):
    return spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def test_a_batch_leaves_no_rows_in_executors(spark, tmp_path, monkeypatch):
    table = MirroredTable(spark, str(tmp_path), "public", "items", buckets=2)
    mirror, kept, publish = Mirror(spark, str(tmp_path), [table], pending_buckets=2), [], Mirror._publish
    monkeypatch.setattr(Mirror, "_publish", lambda self, released, batch: (
        kept.append((persisted(spark), released.count())), publish(self, released, batch))[1])
    before = persisted(spark)
    columns = [("id", 20, True), ("note", 25, False)]
    mirror.apply_batch(feed(spark, [relation(1, 1, "items", columns), row(2, 7, "insert", t(1, "a")), row(3, 8, "insert", t(2, "b")),
                                    row(3, 8, "insert", t(2, "b")), end(4, 7)]), 0)
    mirror.apply_batch(feed(spark, [row(3, 8, "insert", t(2, "b")), row(5, 8, "insert", t(3, "c")), end(6, 8)]), 1)
    assert kept == [(before, 1), (before, 2)]
    assert sorted(map(tuple, mirror.read("public.items").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    folder = session.shared_folder(spark).removeprefix("file:")
    left = [p.name for p in pathlib.Path(folder, "changelake").iterdir() if p.name.split("-")[0] in (
        "arrived", "once", "ends", "behind", "undone", "judged", "waited", "released")]
    assert not left


def test_a_side_over_the_limit_is_not_broadcast(spark):
    rows = spark.range(50).withColumnRenamed("id", "k")
    for limit, name in ((50, "BroadcastHashJoin"), (49, "SortMergeJoin")):
        joined = spark.range(80).selectExpr("id k").join(session.counted(rows, limit), "k")
        assert name in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50


def test_aborted_parts_over_the_limit_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(transactions, "fits", lambda df: False)
    rows = spark.range(40).selectExpr("id xid", "id + 100 sub_xid")
    left = transactions.outside(rows, rows.where("xid < 10"))
    assert "Broadcast" not in left._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.xid for r in left.collect()) == list(range(10, 40))


def test_many_files_are_listed_by_few_tasks(spark, tmp_path):
    other = spark.newSession()
    other.range(60).repartition(60).write.parquet(f"{tmp_path}/in")
    session.few_listing_tasks(other)
    assert int(other.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) == 4 * spark.sparkContext.defaultParallelism
    tracker, group = spark.sparkContext.statusTracker(), "listing"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = other.read.schema("id bigint").parquet(*(str(p) for p in (tmp_path / "in").glob("*.parquet")))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert found.count() == 60
