import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.operators import (
    compaction, decode, maintenance, monitor, relational, relations, snapshots, state, transactions)
from changelake.sources import catalog, inventory
from changelake.sources.envelope import CHANGES, from_json_text, read_changes, select_tables

FEED = "lsn BIGINT, seq INT, xid BIGINT, sub_xid BIGINT, kind STRING, k BIGINT, v STRING"


def test_transactions(spark):
    rows = [
        (1, 0, 10, 10, "insert", 1, "a"), (2, 0, 11, 11, "insert", 2, "b"), (3, 0, 12, 12, "insert", 3, "c"),
        (4, 0, 12, 99, "insert", 4, "d"), (5, 0, 12, 99, "stream_abort", None, None),
        (6, 0, 11, None, "stream_abort", None, None), (7, 0, 12, None, "stream_commit", None, None),
        (8, 0, 10, 10, "commit", None, None), (9, 0, 13, 13, "insert", 5, "e")]
    changes = spark.createDataFrame(rows, FEED)
    seen = {r.k: r.commit_lsn for r in transactions.committed(changes).collect()}
    assert seen == {1: 8, 3: 7}
    assert {r.k for r in transactions.rolled_back(changes).collect()} == {2, 4}
    assert {r.k for r in transactions.pending(changes).collect()} == {5}


@pytest.fixture
def nothing_fits(spark, monkeypatch):
    from changelake import session
    monkeypatch.setattr(session.fits, "__defaults__", (0,))
    monkeypatch.setattr(session.sized, "__defaults__", (0,))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_large_sides_join_without_broadcast(spark, nothing_fits):
    """Beyond the counted size nothing is hinted, and the rows are the same."""
    rows = [(i, 0, i % 50, i % 50 if i % 2 else 100 + i, "insert", i, "x") for i in range(500)]
    rows += [(1000 + x, 0, x, None, "commit", None, None) for x in range(0, 50, 4)]
    rows += [(2000 + x, 0, x % 50, 100 + x, "stream_abort", None, None) for x in range(0, 100, 2)]
    found = transactions.committed(spark.createDataFrame(rows, FEED))
    assert "SortMergeJoin [xid" in found._jdf.queryExecution().toString()
    gone = {x for x in range(0, 100, 2)}
    assert {r.k for r in found.collect()} == {i for i in range(500) if i % 50 % 4 == 0 and i not in gone}


def test_one_transaction_with_a_third_of_the_rows_is_split(spark, nothing_fits):
    n = 60_000
    xid = "if(id % 3 = 0, 7, id % 500)"
    rows = spark.range(n).selectExpr("id lsn", "0 seq", f"{xid} xid", f"{xid} sub_xid", "'insert' kind", "id k",
                                     "repeat(sha2(cast(id as string), 256), 2) v").repartition(8)
    ends = spark.range(500).selectExpr(f"id + {n} lsn", "1 seq", "id xid", "'commit' kind")
    changes = rows.unionByName(ends, allowMissingColumns=True)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        total = state.current_state(transactions.committed(changes), ["k"], ["v"]).agg(
            F.count("k").alias("n"), F.sum(F.length("v")).alias("size"))
        assert tuple(total.first()) == (n, n * 128)
        total.collect()
        assert "skew=true" in total._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


LOG = "k BIGINT, kind STRING, a STRING, a_f STRING, n BIGINT, commit_lsn BIGINT, lsn BIGINT, seq INT"


def _random_log(seed, keys=60, changes=600):
    rng, rows = random.Random(seed), []
    for i in range(changes):
        k, kind = rng.randrange(keys), rng.choice(["insert", "update", "update", "update", "delete"])
        flag = "t" if kind == "insert" else "n" if kind == "delete" else rng.choice("tnuu")
        rows.append((k, kind, f"a{i}" if flag == "t" else None, flag, i if kind != "delete" else None,
                     i // 3, i, 0))
    return rows


def _apply(rows):
    """Brute force: one change after the other."""
    live, known = {}, {}
    for k, kind, a, flag, n, *_ in sorted(rows, key=lambda r: r[5:]):
        if flag != "u":
            known[k] = a
        if kind == "delete":
            live.pop(k, None)
        else:
            live[k] = (known.get(k), n)
    return live


@pytest.mark.parametrize("seed", range(3))
def test_state_against_brute_force(spark, seed):
    rows = _random_log(seed)
    log = spark.createDataFrame(rows, LOG)
    found = state.current_state(log, ["k"], ["a", "n"], ["a"]).collect()
    assert {r.k: (r.a, r.n) for r in found} == _apply(rows)
    cut = state.state_as_of(log, 100, ["k"], ["a", "n"], ["a"]).collect()
    assert {r.k: (r.a, r.n) for r in cut} == _apply([r for r in rows if r[5] <= 100])


@pytest.mark.parametrize("seed, cuts", [(1, [100, 350]), (2, [1, 2, 599]), (3, [300])])
def test_applying_in_parts_is_applying_at_once(spark, seed, cuts):
    rows = _random_log(seed)
    # Every key has a base row, so that nothing is left unresolved in between.
    rows = [(k, "insert", "base", "t", -1, -1, -1, 0) for k in range(60)] + rows
    base, low = None, -1
    for high in [*cuts, 10**6]:
        part = spark.createDataFrame([r for r in rows if low <= r[6] < high], LOG)
        small = state.collapse(part, ["k"], ["a", "n"], ["a"])
        base = (state.current_state(small, ["k"], ["a", "n"], ["a"], positions=True) if base is None
                else state.apply_changes(base, small, ["k"], ["a", "n"], ["a"]))
        base, low = spark.createDataFrame(base.collect(), base.schema), high
    # A key deleted in an earlier part has lost its values, as in the source.
    expected, known = {}, {}
    for k, kind, a, flag, n, *_ in sorted(rows, key=lambda r: r[5:]):
        if flag != "u":
            known[k] = a
        if kind == "delete":
            expected.pop(k, None)
            known[k] = None
        else:
            expected[k] = (known[k], n)
    assert {r.k: (r.a, r.n) for r in base.collect()} == expected


def test_true_null_is_not_unchanged(spark):
    log = spark.createDataFrame([
        (1, "insert", "x", "t", 1, 1, 1, 0), (1, "update", None, "n", 2, 2, 2, 0), (1, "update", None, "u", 3, 3, 3, 0),
        (2, "insert", "y", "t", 1, 1, 4, 0), (2, "update", None, "u", 2, 2, 5, 0),
        (3, "update", None, "u", 1, 1, 6, 0)], LOG)
    found = {r.k: (r.a, r.n) for r in state.current_state(log, ["k"], ["a", "n"], ["a"]).collect()}
    assert found == {1: (None, 3), 2: ("y", 2), 3: (None, 1)}
    assert [(r.k, r.missing) for r in state.unresolved(log, ["k"], ["a", "n"], ["a"]).collect()] == [(3, ["a"])]


def test_order_is_by_commit_not_by_log(spark):
    """Streamed transactions interleave: the later commit wins, whatever its place in the log."""
    log = spark.createDataFrame([(1, "insert", "late", "t", 1, 50, 10, 0), (1, "update", "early", "t", 2, 40, 20, 0)], LOG)
    assert state.current_state(log, ["k"], ["a", "n"], ["a"]).first().a == "late"


def test_key_change_and_truncate(spark):
    rows = [("insert", 1, None, "a", 1), ("truncate", None, None, None, 2), ("insert", 2, None, "b", 3),
            ("update", 5, 2, "b2", 4), ("update", 5, 5, "b3", 5), ("insert", 2, None, "again", 6)]
    log = spark.createDataFrame([(k, i, o, v, 7, l, l, 0) for k, i, o, v, l in rows],
                                "kind STRING, id BIGINT, old_id BIGINT, v STRING, relation_id BIGINT, commit_lsn BIGINT, lsn BIGINT, seq INT")
    split = state.explode_key_change(log, ["id"])
    assert "old_id" not in split.columns
    live = state.current_state(state.after_truncate(split), ["id"], ["v"])
    assert {r.id: r.v for r in live.collect()} == {5: "b3", 2: "again"}


@pytest.mark.parametrize("hot", [2, 10**6])
def test_history(spark, hot):
    log = spark.createDataFrame([(1, "insert", "a", "t", 1, 1, 1, 0), (1, "update", "b", "t", 1, 5, 3, 0),
                                 (1, "delete", None, "n", 1, 6, 4, 0), (2, "insert", "c", "t", 1, 1, 2, 0)], LOG)
    found = {(r.k, r.valid_from): r.valid_to for r in state.history(log, ["k"], hot).collect()}
    assert found == {(1, 1): 3, (1, 3): 4, (1, 4): None, (2, 2): None}


# --- relations and decoding -----------------------------------------------------------------

def _relation(lsn, rid, name, columns):
    cols = [(n, oid, -1, key) for n, oid, key in columns]
    return (lsn, 0, None, None, "relation", None, rid, None, None, ("public", name, cols))


def _row(lsn, kind, rid, new, old=None):
    return (lsn, 0, 1, 1, kind, None, rid, new, old, None)


V1 = [("id", 23, True), ("name", 25, False)]
V2 = [("id", 20, True), ("extra", 701, False), ("name", 25, False)]


@pytest.fixture
def feed(spark):
    return spark.createDataFrame([
        _row(1, "insert", 5, [("t", "0"), ("t", "early")]),
        _relation(2, 5, "users", V1), _relation(3, 5, "users", V1), _relation(4, 6, "other", V1),
        _row(10, "insert", 5, [("t", "1"), ("t", "one")]),
        _row(11, "insert", 6, [("t", "7"), ("t", "seven")]),
        _relation(20, 5, "users", V2),
        _row(30, "update", 5, [("t", "1"), ("t", "2.5"), ("u", None)]),
        _row(31, "insert", 5, [("t", "x2"), ("t", "2.5"), ("n", None)]),
        _row(32, "insert", 5, [("t", "3"), ("z", "2.5"), ("n", None)]),
        _row(33, "delete", 5, None, [("t", "1"), ("n", None), ("n", None)]),
        _row(34, "update", 5, [("t", "9"), ("t", "1"), ("u", None)], [("t", "1"), ("n", None), ("n", None)]),
        _row(35, "update", 5, [("t", "8"), ("t", "1"), ("t", "eight")], [("t", "1"), ("n", None), ("n", None)]),
        _row(36, "insert", 5, [("t", "4")]),
    ], CHANGES)


def test_versions_drop_repeats(spark, feed):
    found = relations.relation_versions(feed).where("relation_id = 5").orderBy("valid_from").collect()
    assert [(r.valid_from.lsn, r.valid_to.lsn if r.valid_to else None) for r in found] == [(2, 20), (20, None)]


@pytest.mark.parametrize("few", [True, False])
def test_binding_by_broadcast_and_by_shuffle(spark, feed, few):
    versions = relations.relation_versions(feed)
    sizes = None if few else relations.Sizes(10**9, 2)
    rows = feed.where("kind <> 'relation'")
    bound = relations.bind_relation(rows, versions, keep_unknown=True, sizes=sizes)
    found = {r.lsn: len(r.relation.columns) if r.relation else None for r in bound.collect()}
    assert found == {1: None, 10: 2, 11: 2, 30: 3, 31: 3, 32: 3, 33: 3, 34: 3, 35: 3, 36: 3}
    assert relations.bind_relation(rows, versions, sizes=sizes).count() == 9
    assert [r.lsn for r in relations.unknown_relation(rows, versions).collect()] == [1]


def test_decode(spark, feed):
    versions = relations.relation_versions(feed)
    shape = relations.TableShape.of(versions, "public", "users", ["extra"])
    assert shape.types == {"id": T.LongType(), "name": T.StringType(), "extra": T.DoubleType()}
    assert shape.keys == ["id"] and shape.carried_values == ["name", "extra"]
    assert relations.TableShape.from_json("public", "users", shape.to_json()).types == shape.types
    decoded = decode.to_columns(decode.bind(feed.where("kind <> 'relation'"), versions, shape), shape)
    good = {r.lsn: (r.kind, r.id, r.old_id, r["name"], r.extra, r.name_f) for r in decode.fit(decoded).collect()}
    assert good == {30: ("update", 1, None, None, 2.5, "u"), 33: ("delete", 1, None, None, None, "n"),
                    34: ("update", 9, 1, None, 1.0, "u"), 35: ("update", 8, 1, "eight", 1.0, "t")}
    bad = {r.lsn: list(r.reasons) for r in decode.quarantine(decoded).collect()}
    assert bad == {10: ["not_null:extra"], 31: ["bad_value:id"], 32: ["bad_kind:extra"],
                   36: ["not_null:extra", "tuple_width"]}
    with pytest.raises(ValueError, match="undecodable"):
        decode.require_fit(decoded)
    counts = {r.reason: r.errors for r in monitor.error_counts(decode.quarantine(decoded)).collect()}
    assert counts["not_null:extra"] == 2
    named = feed.where("lsn = 10").drop("relation")
    cells = relations.bind_relation(named, versions).select(decode.tuple_map().alias("m")).first().m
    assert cells["name"].v == "one"


def test_struct_type_keeps_order_and_numbers():
    shape = relations.TableShape("public", "t", [("id", 23, -1, True), ("name", 25, -1, False), ("value", 701, -1, False),
                                                 ("odd", 12345, -1, False)], ["id", "value"])
    fields = [(f.name, f.dataType, f.nullable, f.metadata["field_id"]) for f in shape.struct_type()]
    assert fields == [("id", T.IntegerType(), False, 1), ("name", T.StringType(), True, 2),
                      ("value", T.DoubleType(), False, 3), ("odd", T.StringType(), True, 4)]


def test_nullability_goes_by_name(spark):
    message = spark.createDataFrame([("public", "t", "b", 25), ("public", "t", "a", 23), ("public", "t", "c", 25)],
                                    "namespace STRING, name STRING, column_name STRING, type_oid BIGINT")
    known = spark.createDataFrame([("public", "t", "a", False, "int4"), ("public", "t", "b", True, "text")],
                                  "namespace STRING, name STRING, column_name STRING, nullable BOOLEAN, type_name STRING")
    found = {r.column_name: (r.nullable, r.type_name) for r in relations.merge_nullability(message, known).collect()}
    assert found == {"a": (False, "int4"), "b": (True, "text"), "c": (True, "")}


def test_catalog(spark):
    columns = spark.createDataFrame(
        [("public", "t", "b", 2, "YES", "pg_catalog", "text"), ("public", "t", "a", 1, "NO", "pg_catalog", "int4")],
        "table_schema STRING, table_name STRING, column_name STRING, ordinal_position INT, is_nullable STRING, udt_schema STRING, udt_name STRING")
    types = spark.createDataFrame([("pg_catalog", "text", 25), ("other", "text", 7), ("pg_catalog", "int4", 23)],
                                  "type_namespace STRING, type_name STRING, type_oid BIGINT")
    row = catalog.table_schemas(catalog.read_columns(columns, types, [("public", "t")])).first()
    assert [(c.field_id, c["name"], c.type_oid, c.nullable) for c in row.columns] == [(1, "a", 23, False), (2, "b", 25, True)]
    assert catalog.read_columns(columns, types, [("public", "x")]).isEmpty()
    assert catalog.known_types(spark).where("type_oid = 20").first().table_type == "long"


def test_feed_reading(spark, feed, tmp_path):
    feed.write.parquet(str(tmp_path / "p"))
    feed.write.json(str(tmp_path / "j"))
    assert read_changes(spark, str(tmp_path / "p"), start=30).count() == 7
    assert read_changes(spark, str(tmp_path / "j"), "json").exceptAll(feed).isEmpty()
    text = feed.select(F.to_json(F.struct(*feed.columns)).alias("value"))
    assert from_json_text(text).exceptAll(feed).isEmpty()
    versions = relations.relation_versions(feed)
    bound = relations.bind_relation(feed.where("kind <> 'relation'"), versions).select("lsn", "relation.namespace", "relation.name")
    assert [r.lsn for r in select_tables(bound, [("public", "other")]).collect()] == [11]


# --- files ----------------------------------------------------------------------------------

@pytest.mark.parametrize("files, groups", [(0, 0), (1, 0), (2, 1), (5, 1), (6, 1), (7, 2), (11, 2)])
def test_groups_of_five(spark, files, groups):
    """A last group of one file is left alone."""
    listed = spark.createDataFrame([("d", f"d/f{i:03}", 10) for i in range(files)], "dir STRING, path STRING, length BIGINT")
    plan = compaction.plan_by_count(listed)
    assert plan.select("grp").distinct().count() == groups


@pytest.mark.parametrize("hot", [3, 10**6])
def test_groups_by_size(spark, hot):
    listed = spark.createDataFrame([("d", f"d/f{i:03}", n) for i, n in enumerate([40, 50, 200, 30, 90, 10, 5])],
                                   "dir STRING, path STRING, length BIGINT")
    plan = compaction.plan_by_bytes(listed, 100, hot)
    groups = {}
    for r in plan.collect():
        groups.setdefault(r.grp, []).append(r.path[-1])
    assert {k: sorted(v) for k, v in groups.items()} == {0: ["0", "1", "3"], 2: ["5", "6"]}


def _table(spark, path, files, start=0):
    df = spark.range(start, start + files * 2).selectExpr("id", "concat('test', id) name")
    df.repartition(files).write.mode("append").parquet(path)


def test_compact_tables(spark, tmp_path):
    root = tmp_path / "root"
    for name, files in (("table1", 3), ("table2", 12), ("single", 1)):
        (root / name / "metadata").mkdir(parents=True)
        (root / name / "metadata" / "metadata.json").write_text("{}")
        _table(spark, str(root / name / "data" / "partition_1"), files)
    (root / "plain").mkdir()
    _table(spark, str(root / "table2" / "data"), 4, 1000)
    paths = {name: f"file:{root}/{name}" for name in ("table1", "table2", "single")}
    found = inventory.discover_tables(inventory.list_files(spark, str(root)), f"file:{root}")
    assert {r.table_dir for r in found.collect()} == set(paths.values())
    before = {n: maintenance.read_table(spark, p) for n, p in paths.items()}
    rows = {n: sorted(map(tuple, df.collect())) for n, df in before.items()}
    stats = maintenance.compact(spark, str(root)).first()
    assert (stats.tables_processed, stats.files_processed, stats.run) == (3, 19, 1)
    for name, path in paths.items():
        assert sorted(map(tuple, maintenance.read_table(spark, path).collect())) == rows[name]
    assert maintenance.table_files(spark, paths["table1"]).count() == 1
    assert maintenance.table_files(spark, paths["table2"]).count() == 4
    later = datetime.datetime.now() + datetime.timedelta(days=1)
    unused = maintenance.vacuum_candidates(spark, paths["table2"], later)
    assert unused.count() == 16
    assert maintenance.vacuum_candidates(spark, paths["table2"], datetime.datetime(2000, 1, 1)).isEmpty()
    assert compaction.remove_files(spark, unused) == 16
    assert sorted(map(tuple, maintenance.read_table(spark, paths["table2"]).collect())) == rows["table2"]


def test_rewrite_in_several_jobs_and_pieces(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(4000).selectExpr("id", "uuid() u").repartition(9).write.parquet(source)
    files = inventory.file_inventory(spark, source)
    plan = compaction.plan_by_count(files, 3)
    written = compaction.rewrite(spark, plan, out, target=15_000, files_per_job=3)
    assert written.agg(F.sum("record_count")).first()[0] == 4000
    merged = spark.read.option("recursiveFileLookup", "true").parquet(out)
    assert merged.exceptAll(spark.read.parquet(source)).isEmpty() and merged.count() == 4000
    assert written.count() > 3


def test_listing(spark, tmp_path):
    for name in ("file1.parquet", "file2.parquet", "file3.txt", "sub dir/file4.parquet"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    files = inventory.file_inventory(spark, str(tmp_path))
    assert files.count() == 3
    assert files.inputFiles() and "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    names = inventory.relative_names(files, f"file:{tmp_path}")
    assert {r["name"] for r in names.collect()} == {"file1.parquet", "file2.parquet", "sub dir/file4.parquet"}
    assert inventory.data_dirs(inventory.list_files(spark, str(tmp_path))).count() == 2


def test_snapshots(spark):
    files = spark.createDataFrame(
        [("t", 1, "a", 1, 10, 100), ("t", 2, "b", 1, 5, 50), ("t", 3, "a", 3, 10, 100), ("t", 3, "c", 1, 15, 150)],
        "table_name STRING, snapshot_id BIGINT, path STRING, status INT, record_count BIGINT, bytes BIGINT")
    assert {r.path for r in snapshots.live_files(files).collect()} == {"b", "c"}
    assert {r.path for r in snapshots.live_files(files, 2).collect()} == {"a", "b"}
    summary = snapshots.snapshot_summary(files)
    found = {r.snapshot_id: (r.added_files, r.added_records, r.total_files, r.total_records) for r in summary.collect()}
    assert found == {1: (1, 10, 1, 10), 2: (1, 5, 2, 15), 3: (1, 15, 2, 20)}
    text = snapshots.summary_map(summary).where("snapshot_id = 3").first().summary
    assert text == {"added-data-files": "1", "total-data-files": "2", "total-records": "20"}
    known = spark.createDataFrame([("t", 7, 1), ("t", 9, 2), ("u", 4, 1)], "table_name STRING, snapshot_id BIGINT, sequence BIGINT")
    for hot in (1, 10**6):
        chain = snapshots.snapshot_chain(known, hot)
        assert {(r.table_name, r.snapshot_id): r.parent_snapshot_id for r in chain.collect()} == {("t", 7): 0, ("t", 9): 7, ("u", 4): 0}


def test_file_metrics_and_pruning(spark, tmp_path):
    spark.range(100).selectExpr("id", "if(id < 10, null, id) v").repartitionByRange(4, "id").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    metrics = snapshots.file_metrics(table, ["id", "v"])
    assert metrics.count() == 8 and metrics.agg(F.sum("null_count")).first()[0] == 10
    assert snapshots.prune_files(metrics, "id", 40, 45, "bigint").count() <= 2
    assert snapshots.files_added(table).agg(F.sum("record_count")).first()[0] == 100


# --- monitoring and SQL ---------------------------------------------------------------------

def test_status_rollup(spark):
    checks = spark.createDataFrame([("a", "healthy"), ("b", "unhealthy"), ("c", "degraded")], "component STRING, status STRING")
    assert monitor.status_rollup(checks).first().status == "unhealthy"
    assert monitor.status_rollup(checks.where("component <> 'b'")).first().status == "degraded"
    assert monitor.status_rollup(checks.where("component = 'a'")).first().status == "healthy"


def test_histogram_and_slow_queries(spark):
    log = spark.createDataFrame([(0.004,), (0.3,), (20.0,)], "s DOUBLE")
    found = {r.le: r.at_most for r in monitor.duration_histogram(log, "s").collect()}
    assert found[0.005] == 1 and found[0.25] == 1 and found[0.5] == 2 and found[10.0] == 2 and found[float("inf")] == 3
    assert monitor.slow_queries(log, "s", 300).count() == 2 and monitor.slow_queries(log, "s", 0).count() == 0


def test_lag_and_counts(spark, feed):
    applied = spark.createDataFrame([(5, 30)], "relation_id BIGINT, max_lsn BIGINT")
    found = {r.relation_id: r.lag_bytes for r in monitor.lag_by_table(feed, applied).collect()}
    assert found == {5: 6, 6: 11}
    counts = {r.kind: r.messages for r in monitor.kind_counts(feed.withColumn(
        "kind", F.when(F.col("lsn") == 1, "strange").otherwise(F.col("kind")))).collect()}
    assert counts["relation"] == 4 and counts["unknown"] == 1


def test_sql(spark):
    spark.range(5).createOrReplaceTempView("five")
    assert relational.query(spark, "select 42 x").first().x == 42
    assert relational.query(spark, "select :b - :a d", {"a": 1, "b": 5}).first().d == 4
    assert relational.query(spark, "select id from five where id = ?", [3]).first().id == 3
    described = relational.describe(spark.sql("select 1 a, cast(1 as bigint) b, 'x' c, cast(1 as decimal(5,2)) d, current_date() e, true f"))
    assert [r.source_type for r in described.orderBy("ordinal").collect()] == ["int4", "int8", "text", "numeric", "date", "bool"]
    child, parent = spark.createDataFrame([(1, 999), (2, 1), (3, None)], "id INT, user_id INT"), spark.createDataFrame([(1,)], "id INT")
    assert [r.id for r in relational.orphans(child, parent, [("user_id", "id")]).collect()] == [1]


def test_query_log(spark, tmp_path):
    log = str(tmp_path / "log")
    assert relational.run_logged(spark, "select :x x", log, {"x": 3}).first().x == 3
    with pytest.raises(Exception):
        relational.run_logged(spark, "select * from no_such_table", log)
    rows = spark.read.parquet(log)
    assert {r.status for r in rows.collect()} == {"ok", "error"}
    assert monitor.duration_histogram(rows, "seconds").where("le = 'Infinity'").first().at_most == 2
    assert monitor.query_counts(rows, "status").count() == 2


def test_views_kept_small(spark):
    relational.register({"few": spark.range(3), "many": spark.range(300_000)}, keep_small=True)
    assert spark.catalog.isCached("few") and not spark.catalog.isCached("many")
    assert "Exchange" not in spark.sql("select count(*) from few")._jdf.queryExecution().executedPlan().toString()
