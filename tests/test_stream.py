"""The replication job against one-batch results: cuts, repeats, redelivery, aborts, DDL."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.operators import monitor
from changelake.sources.envelope import CHANGES, read_changes
from changelake.sources.logs import remove
from changelake.streaming.mirror import STEP, Mirror
from changelake.streaming.table import MirroredTable


def relation(lsn, rid, name, columns):
    cols = [(n, oid, -1, key) for n, oid, key in columns]
    return (lsn, 0, None, None, "relation", None, rid, None, None, ("public", name, cols))


def row(lsn, xid, kind, new=None, old=None, sub=None, rid=1):
    return (lsn, 0, xid, xid if sub is None else sub, kind, None, rid, new, old, None)


def end(lsn, xid, kind="commit", sub=None):
    return (lsn, 1, xid, sub, kind, None, None, None, None, None)


def t(*cells):
    return [("u", None) if c == "~" else ("n", None) if c is None else ("t", str(c)) for c in cells]


USERS = [("id", 20, True), ("name", 25, False), ("age", 23, False)]
ITEMS = [("id", 23, True), ("note", 25, False)]

FEED = [
    relation(1, 1, "users", USERS), relation(2, 2, "items", ITEMS),
    row(10, 100, "insert", t(1, "ann", 30)), row(11, 100, "insert", t(2, "bob", 40)),
    row(12, 101, "insert", t(5, "x"), rid=2), end(13, 100),
    row(14, 102, "update", t(1, "~", 31)),                        # open for long
    row(15, 103, "insert", t(3, "gone", 1)), end(16, 103, "stream_abort"),
    row(17, 104, "insert", t(4, "kept", 4)), row(18, 104, "insert", t(6, "sub", 6), sub=900),
    end(19, 104, "stream_abort", 900), end(20, 101),
    row(21, 105, "delete", old=t(2, None, None)), end(22, 105), end(23, 104, "stream_commit"),
    row(24, 106, "update", t(7, "moved", 50), old=t(4, None, None)), end(25, 106),
    row(26, 107, "insert", t(5, "bad", "old")), row(27, 107, "insert", t(8, "eve", 8)), end(28, 107),
    end(29, 102),
    row(30, 108, "update", t(1, "~", None)), row(31, 108, "truncate", rid=2),
    row(32, 108, "insert", t(6, "new"), rid=2), end(33, 108),
    row(34, 109, "update", t(1, "never", 99)),                     # never ends
]
USERS_AFTER = {(1, "ann", None), (7, "moved", 50), (8, "eve", 8)}
ITEMS_AFTER = {(6, "new")}


def mirror(spark, path, **options):
    root = str(path)
    return Mirror(spark, root, [MirroredTable(spark, root, "public", "users", buckets=3),
                                MirroredTable(spark, root, "public", "items", buckets=2)],
                  pending_buckets=2, **options)


def contents(m, name):
    df = m.read(f"public.{name}")
    return set() if df is None else {tuple(r) for r in df.collect()}


def test_cuts_repeats_and_redelivery(spark, tmp_path, monkeypatch):
    """Batches cut inside transactions, one run twice, rows and markers delivered again."""
    m = mirror(spark, tmp_path / "m")
    bounds = [(0, 18), (14, 24), (20, 99)]  # overlapping: the overlap comes twice
    append = MirroredTable.append

    def fails(table, *args):
        if table.name == "users":
            raise RuntimeError("lost")
        return append(table, *args)

    for n, (low, high) in enumerate(bounds):
        batch = spark.createDataFrame([r for r in FEED if low <= r[0] < high], CHANGES)
        if n == 2:
            # It stops between two tables; readers see neither until the batch is finished.
            monkeypatch.setattr(MirroredTable, "append", fails)
            with pytest.raises(RuntimeError, match="lost"):
                m.apply_batch(batch, n)
            monkeypatch.setattr(MirroredTable, "append", append)
            assert contents(m, "users") == before and contents(m, "items") == {(5, "x")}
        m.apply_batch(batch, n)
        if n == 1:
            # The job stopped after the batch, and after maintenance that builds on it.
            before = contents(m, "users")
            m.compact(n)
            m.trim_pending()
            remove(spark, f"{m.root}/_feed/batches/batch={n}")
            m.apply_batch(batch.unionByName(batch), n)
            assert contents(m, "users") == before
    assert contents(m, "users") == USERS_AFTER and contents(m, "items") == ITEMS_AFTER
    assert {r.xid for r in m.pending().collect()} == {109}
    assert [(r.table_name, r.xid, r.reasons) for r in m.errors().collect()] == [("public.users", 107, ["bad_value:age"])]
    users = m.tables["public.users"]
    log = users.read_log()
    assert log.where("xid in (103, 109)").isEmpty() and log.where("name = 'sub'").isEmpty()
    assert log.groupBy("lsn", "kind", "id").count().where("count > 1").isEmpty()
    assert {tuple(r) for r in users.read_at_lsn(13).collect()} == {(1, "ann", 30), (2, "bob", 40)}
    assert {tuple(r) for r in m.read("public.users", as_of=STEP).collect()} == {(1, "ann", 30), (2, "bob", 40)}
    chain = users.snapshots().orderBy("sequence").collect()
    assert [(r.sequence, r.snapshot_id, r.parent_snapshot_id) for r in chain] == [
        (1, STEP, 0), (2, 2 * STEP, STEP), (3, 2 * STEP + 1, 2 * STEP), (4, 3 * STEP, 2 * STEP + 1)]
    lag = {r.table_name: r.lag_bytes for r in m.lag().collect()}
    assert lag == {"public.users": 1, "public.items": 1}
    assert sorted(m.register()) == ["items", "public_items", "public_users", "users"]
    assert spark.sql("select count(*) n from users u join items i on i.id <> u.id").first().n == 3


def test_stream_merge_on_read_and_maintenance(spark, tmp_path):
    """The stream, unfolded batches, then merging, trimming and cleaning up change no row."""
    m = mirror(spark, tmp_path / "m", fold_every=2)
    source = str(tmp_path / "in")
    for low, high in [(0, 20), (20, 26), (26, 99)]:
        spark.createDataFrame([r for r in FEED if low <= r[0] < high], CHANGES).repartition(2).write.mode("append").parquet(source)
        m.run(read_changes(spark, source, streaming=True))
    assert m.last_batch() == 2
    users = m.tables["public.users"]
    assert users.snapshot().folded_through == 2 * STEP
    assert contents(m, "users") == USERS_AFTER and contents(m, "items") == ITEMS_AFTER
    log = sorted(map(str, users.read_log().collect()))
    m.trim_pending()
    assert {r.xid for r in m.pending().collect()} == {109}
    m.compact(1)
    assert m.compactions().first().files_processed >= 2
    health = m.health(10**6, 10**9)
    assert health.count() == 4 and monitor.status_rollup(health).first().status == "healthy"
    assert monitor.status_rollup(m.health(1, 10**9)).first().status == "degraded"
    assert users.snapshot().operation == "compact"
    assert sorted(map(str, users.read_log().collect())) == log
    assert contents(m, "users") == USERS_AFTER
    later = datetime.datetime.now() + datetime.timedelta(days=1)
    assert users.vacuum(later) > 0
    assert contents(m, "users") == USERS_AFTER
    assert sorted(map(str, users.read_log().collect())) == log
    end_it = spark.createDataFrame([end(40, 109)], CHANGES)
    m.apply_batch(end_it, 3)
    assert users.live().where("status = 2").count() > 0
    assert Mirror(spark, str(tmp_path / "m"), [MirroredTable(spark, str(tmp_path / "m"), "public", "users", buckets=7)]
                  ).tables["public.users"].info().buckets == 3
    assert (1, "never", 99) in contents(m, "users")
    counts = {r.kind: r.messages for r in m.message_counts().collect()}
    assert counts["relation"] == 2 and counts["truncate"] == 1


@pytest.mark.parametrize("strict", [False, True])
def test_new_and_wider_columns(spark, tmp_path, strict):
    root = str(tmp_path / "m")
    m = Mirror(spark, root, [MirroredTable(spark, root, "public", "items", buckets=2, strict=strict)], pending_buckets=2)
    first = [relation(1, 2, "items", ITEMS), row(2, 1, "insert", t(1, "a"), rid=2),
             row(3, 1, "insert", t(2, "b"), rid=2), row(4, 1, "update", t(9, "~"), rid=2), end(5, 1)]
    wider = [relation(10, 2, "items", [("id", 20, True), ("size", 701, False), ("note", 25, False)]),
             row(11, 2, "update", t(1, 1.5, "~"), rid=2), row(12, 2, "insert", t(2**40, 2.5, "big"), rid=2), end(13, 2)]
    m.apply_batch(spark.createDataFrame(first, CHANGES), 0)
    m.apply_batch(spark.createDataFrame(wider, CHANGES), 1)
    state = m.read("public.items")
    assert dict(state.dtypes) == {"id": "bigint", "note": "string", "size": "double"}
    lost = set() if strict else {(9, None, None)}
    assert {tuple(r) for r in state.select("id", "note", "size").collect()} == {
        (1, "a", 1.5), (2, "b", None), (2**40, "big", 2.5)} | lost
    table = m.tables["public.items"]
    assert [(r.key, r.missing, r.reason) for r in table.errors().collect()] == [
        ('{"id":9}', ["note"], "unchanged_without_base")]
    assert table.read_log().count() == 5
    assert m.read("public.items", as_of=STEP).schema["id"].dataType == T.IntegerType()
    assert m.errors().where(F.array_contains("reasons", "unknown_relation")).isEmpty()
