"""Nothing is lost without a trace: mixed shapes, late and malformed messages, tables without a key."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_stream import end, relation, row, t

from changelake.functions.types import wider
from changelake.operators import compaction, maintenance
from changelake.sources import inventory
from changelake.sources.envelope import CHANGES, from_json_text
from changelake.streaming.mirror import Mirror
from changelake.streaming.table import MirroredTable

OLD = [("id", 23, True), ("note", 25, False)]
NEW = [("id", 20, True), ("note", 25, False), ("size", 701, False)]


def feed(spark, rows):
    return spark.createDataFrame(rows, CHANGES)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def named_rows(df):
    """Rows with columns in the order of their names."""
    return rows_of(df.select(*sorted(df.columns)))


def test_compaction_keeps_columns_of_every_shape(spark, tmp_path):
    table = MirroredTable(spark, str(tmp_path), "public", "items", buckets=2)
    m = Mirror(spark, str(tmp_path), [table])
    m.apply_batch(feed(spark, [relation(1, 1, "items", OLD), row(2, 1, "insert", t(1, "a")), end(3, 1)]), 0)
    m.apply_batch(feed(spark, [row(4, 2, "insert", t(2, "b")), end(5, 2)]), 1)
    m.apply_batch(feed(spark, [relation(6, 1, "items", NEW), row(7, 3, "insert", t(1 << 40, "c", 3.5)), end(8, 3)]), 2)
    m.apply_batch(feed(spark, [row(9, 4, "insert", t(4, "d", 4.5)), end(10, 4)]), 3)
    before, log, early = rows_of(m.read("public.items")), named_rows(table.read_log()), rows_of(table.read_at_lsn(8))
    assert [r[2] for r in before] == [None, 3.5, None, 4.5]
    assert table.compact() is not None
    assert table.live().where("area = 'archive'").count() >= 2
    assert named_rows(table.read_log()) == log and rows_of(table.read_at_lsn(8)) == early
    assert rows_of(m.read("public.items")) == before


def test_plain_directories_with_two_schemas(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").coalesce(1).write.parquet(source)
    spark.createDataFrame([(3, "c", 0.5)], "id int, v string, extra double").coalesce(1).write.mode("append").parquet(source)
    compaction.rewrite(spark, compaction.plan_by_count(inventory.file_inventory(spark, source)), out)
    got = spark.read.option("recursiveFileLookup", "true").parquet(out)
    assert rows_of(got.select("id", "v", "extra")) == [(1, "a", None), (2, "b", None), (3, "c", 0.5)]
    table = tmp_path / "root" / "items"
    (table / "metadata").mkdir(parents=True)
    for i, extra in enumerate((False, True)):
        rows = spark.createDataFrame([(i, 7)], "id int, extra int") if extra else spark.createDataFrame([(i,)], "id int")
        rows.coalesce(1).write.mode("append").parquet(str(table / "data"))
    maintenance.compact(spark, str(tmp_path / "root"))
    assert rows_of(maintenance.read_table(spark, str(table)).select("id", "extra")) == [(0, None), (1, 7)]


def test_table_without_a_key_beside_one_with(spark, tmp_path):
    tables = [MirroredTable(spark, str(tmp_path), "public", n, buckets=2) for n in ("events", "items")]
    m = Mirror(spark, str(tmp_path), tables)
    plain = [("label", 25, False), ("n", 23, False)]
    m.apply_batch(feed(spark, [
        relation(1, 1, "items", OLD), relation(2, 2, "events", plain), relation(3, 3, "others", plain),
        row(4, 1, "insert", t(1, "a")), row(5, 1, "insert", t("x", 1), rid=2), row(6, 1, "insert", t("x", 1), rid=2),
        row(7, 1, "insert", t("y", None), rid=2), row(8, 1, "insert", t("z", 9), rid=3), end(9, 1)]), 0)
    m.apply_batch(feed(spark, [row(10, 2, "insert", t("w", 4), rid=2), end(11, 2)]), 1)
    assert rows_of(m.read("public.events")) == [("w", 4), ("x", 1), ("x", 1), ("y", None)]
    assert rows_of(tables[0].read_at_lsn(9)) == [("x", 1), ("x", 1), ("y", None)]
    assert rows_of(m.read("public.items")) == [(1, "a")]
    counts = {r["kind"]: r["messages"] for r in m.message_counts().collect()}
    assert counts["not selected: public.others"] == 1 and counts["insert"] == 6


def test_late_rows_are_applied_or_listed(spark, tmp_path):
    table = MirroredTable(spark, str(tmp_path), "public", "items", buckets=2, horizon=0)
    m = Mirror(spark, str(tmp_path), [table])
    m.apply_batch(feed(spark, [relation(1, 1, "items", OLD), row(4, 1, "insert", t(1, "a")), end(5, 1), end(9, 7)]), 0)
    # A row that lands after its marker, above what was applied; one delivered again.
    m.apply_batch(feed(spark, [row(8, 7, "insert", t(2, "after its marker")), row(4, 1, "insert", t(1, "a"))]), 1)
    assert rows_of(m.read("public.items")) == [(1, "a"), (2, "after its marker")]
    # A transaction that commits below what was applied, and a row of one that has ended there: both
    # lie below a horizon of no width.
    m.apply_batch(feed(spark, [row(2, 3, "insert", t(3, "late")), end(3, 3), row(3, 1, "insert", t(4, "late too"))]), 2)
    assert rows_of(m.read("public.items")) == [(1, "a"), (2, "after its marker")]
    assert rows_of(m.errors().select("lsn", F.col("reasons")[0])) == [(2, "late_commit"), (3, "late_commit")]
    assert m.pending().count() == 0


def test_unchanged_value_from_a_full_old_tuple(spark, tmp_path):
    m = Mirror(spark, str(tmp_path), [MirroredTable(spark, str(tmp_path), "public", "items", buckets=2)])
    m.apply_batch(feed(spark, [
        relation(1, 1, "items", OLD), row(2, 1, "update", t(1, "~"), old=t(1, "kept")),
        row(3, 1, "update", t(6, "~"), old=t(5, "moved")), end(4, 1)]), 0)
    assert rows_of(m.read("public.items")) == [(1, "kept"), (6, "moved")]
    assert m.errors().count() == 0


def test_malformed_envelopes_are_listed(spark, tmp_path):
    good = {"lsn": 5, "seq": 0, "xid": 1, "kind": "begin"}
    texts = [json.dumps(good), "{broken", "also broken", '{"lsn": 7}', "also broken", None, "[]"]
    messages = from_json_text(spark.createDataFrame([(x,) for x in texts], "value string"))
    assert messages.columns == spark.createDataFrame([], CHANGES).columns
    m = Mirror(spark, str(tmp_path), [MirroredTable(spark, str(tmp_path), "public", "items", buckets=2)])
    m.apply_batch(messages, 0)
    found = {r["reasons"][1] for r in m.errors().collect()}
    assert found == {"{broken", "also broken", '{"lsn": 7}', None, "[]"}
    assert m.batches().first()["last_lsn"] == 5


def test_views_carry_their_schema(spark, tmp_path):
    tables = [MirroredTable(spark, str(tmp_path), s, "u", buckets=1) for s in ("public", "audit")]
    m = Mirror(spark, str(tmp_path), tables)
    audit = (2, 0, None, None, "relation", None, 2, None, None, ("audit", "u", [(n, o, -1, k) for n, o, k in OLD]))
    m.apply_batch(feed(spark, [relation(1, 1, "u", OLD), audit, row(3, 1, "insert", t(1, "p")),
                               row(4, 1, "insert", t(2, "q"), rid=2), end(5, 1)]), 0)
    assert sorted(m.register()) == ["audit_u", "public_u"]
    assert spark.table("public_u").first()["note"] == "p" and spark.table("audit_u").first()["note"] == "q"


def test_wider_numbers_and_dates():
    assert wider(T.IntegerType(), T.DecimalType(8, 2)) == T.DecimalType(12, 2)
    assert wider(T.DecimalType(20, 4), T.LongType()) == T.DecimalType(23, 4)
    assert wider(T.IntegerType(), T.DoubleType()) == wider(T.FloatType(), T.IntegerType()) == T.DoubleType()
    assert wider(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType()
    assert wider(T.DateType(), T.TimestampType()) == T.TimestampType()
    assert wider(T.LongType(), T.DoubleType()) == wider(T.FloatType(), T.DecimalType(9, 2)) == T.StringType()
