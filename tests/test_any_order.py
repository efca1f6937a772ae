"""Changes in any order, growing states, moved rows, copied rows, and tables that fail."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_no_loss import feed, rows_of
from test_stream import end, relation, row, t

from changelake.functions.ordering import bisect
from changelake.functions.partitioning import PartitionField, linear_bucket, split_from
from changelake.operators import maintenance, relations, state
from changelake.sources.envelope import read_changes
from changelake.sources.logs import read_log
from changelake.streaming.mirror import Mirror
from changelake.streaming.table import ERRORS, MirroredTable

NOTES = [("id", 20, True), ("note", 25, False), ("n", 23, False)]


def one_table(spark, path, name="items", **options):
    table = MirroredTable(spark, str(path), "public", name, **{"buckets": 2, "horizon": None, **options})
    return table, Mirror(spark, str(path), [table], pending_buckets=2)


def test_bisect_in_arrays_of_any_length(spark):
    rows = [(n, x) for n in range(10) for x in (None, -1, *range(0, 22))]
    df = spark.createDataFrame(rows, "n int, x int").withColumn("a", F.expr("transform(sequence(1, n + 1), i -> 2 * i)"))
    df = df.withColumn("a", F.slice("a", F.lit(1), F.col("n")))
    for longest in (9, 100):
        for r in df.withColumn("found", bisect(F.col("a"), F.col("x"), longest)).collect():
            assert r["found"] == (0 if r["x"] is None else sum(v <= r["x"] for v in r["a"]))


@pytest.mark.parametrize("known", [None, relations.Sizes(10**9, 3000)])
def test_binding_to_thousands_of_versions(spark, known):
    """Three levels of nodes; rows before the first version, at one, between two, and of no relation."""
    messages = spark.range(3000).selectExpr("7L relation_id", "id * 10 + 5 lsn", "0 seq", "'relation' kind", "struct(id v) relation")
    other = spark.range(2).selectExpr("8L relation_id", "id * 100 + 50 lsn", "0 seq", "'relation' kind", "struct(id v) relation")
    versions = relations.relation_versions(messages.union(other))
    rows = spark.range(0, 30_020, 3).selectExpr("cast(id % 3 + 7 as bigint) relation_id", "id lsn", "cast(id % 2 as int) seq").union(
        spark.range(0, 30_020, 7).selectExpr("7L", "id", "0"))
    got = relations.bind_relation(rows, versions, True, known).select("relation_id", "lsn", F.col("relation.v").alias("v")).collect()
    assert len(got) == rows.count()
    for rid, lsn, v in got:
        want = {7: (lsn - 5) // 10 if lsn >= 5 else None, 8: None if lsn < 50 else min(1, (lsn - 50) // 100)}.get(rid)
        assert v == (want if rid != 7 or want is None else min(want, 2999)), (rid, lsn)


def test_linear_buckets_split_one_at_a_time(spark):
    keys = spark.range(3000)
    last = {r["id"]: r["b"] for r in keys.select("id", linear_bucket(["id"], 3, 3).alias("b")).collect()}
    for count in range(4, 15):
        now = {r["id"]: r["b"] for r in keys.select("id", linear_bucket(["id"], 3, count).alias("b")).collect()}
        moved = {k for k in now if now[k] != last[k]}
        assert {now[k] for k in moved} == {count - 1} and {last[k] for k in moved} == {split_from(count - 1, 3, count - 1)}
        assert set(now.values()) == set(range(count))
        last = now
    assert [split_from(b, 3, 3) for b in range(12)] == [0, 1, 2] * 4


def test_state_grows_by_splits_and_tasks_share_a_bucket(spark, tmp_path):
    table, m = one_table(spark, tmp_path, bucket_bytes=6_000, task_bytes=2_000)
    want, lsn = {}, 1
    rng = random.Random(2)
    for batch in range(4):
        rows = [relation(lsn, 1, "items", NOTES)]
        for _ in range(300):
            lsn += 1
            k, note = rng.randrange(100 << batch), "%030x" % rng.getrandbits(120)
            want[k] = (k, note, batch)
            rows.append(row(lsn, 7 + batch, "insert", t(k, note, batch)))
        lsn += 1
        m.apply_batch(feed(spark, [*rows, end(lsn, 7 + batch)]), batch)
        assert rows_of(m.read("public.items")) == sorted(want.values(), key=repr)
    counts = [r["buckets"] for r in table.snapshots().orderBy("snapshot_id").collect()]
    assert counts == sorted(counts) and counts[-1] > counts[0] >= 2
    files = table.live().where("area = 'data'").groupBy("bucket").count().collect()
    assert {r["bucket"] for r in files} <= set(range(counts[-1])) and max(r["count"] for r in files) > 1
    keys = spark.read.option("basePath", f"{table.path}/data").parquet(
        *[r["path"] for r in table.live().where("area = 'data'").collect()]).select("id", "bucket", linear_bucket(["id"], 2, counts[-1]).alias("b"))
    assert keys.where("bucket <> b").count() == 0


def random_feed(seed, truncate=True):
    """(transactions, final rows): a transaction is its messages, marker last."""
    rng, lsn, transactions, live = random.Random(seed), 10, [], {}
    for x in range(40):
        messages, change = [], dict(live)
        for _ in range(rng.randint(1, 4)):
            lsn += 2
            k = rng.randrange(8)
            kind = rng.choice(["put", "put", "open", "open", "delete"] + ["truncate"] * (truncate and x % 13 == 5))
            if kind == "truncate":
                change.clear()
                messages.append(row(lsn, 100 + x, "truncate"))
            elif kind == "delete" and k in change:
                del change[k]
                messages.append(row(lsn, 100 + x, "delete", old=t(k, None, None)))
            elif kind == "open" and k in change:
                change[k] = (change[k][0], lsn)
                messages.append(row(lsn, 100 + x, "update", t(k, "~", lsn)))
            else:
                change[k] = (f"v{lsn}", lsn)
                messages.append(row(lsn, 100 + x, "update" if k in live else "insert", t(k, f"v{lsn}", lsn)))
        lsn += 2
        if rng.random() < 0.15:
            messages.append(end(lsn, 100 + x, "stream_abort"))
        else:
            live = change
            messages.append(end(lsn, 100 + x))
        transactions.append(messages)
    return transactions, sorted(((k, *v) for k, v in live.items()), key=repr)


@pytest.mark.parametrize("seed, fold_every", [(1, 1), (2, 2), (3, 3)])
def test_messages_in_any_order(spark, tmp_path, seed, fold_every):
    """Every message in a batch of its own choosing, some of them twice."""
    transactions, want = random_feed(seed)
    table = MirroredTable(spark, str(tmp_path), "public", "items", buckets=2, horizon=None, bucket_bytes=4_000)
    m = Mirror(spark, str(tmp_path), [table], fold_every=fold_every, pending_buckets=2)
    rng, batches = random.Random(seed), [[] for _ in range(5)]
    for messages in transactions:
        for message in messages:
            for _ in range(1 + (rng.random() < 0.2)):
                rng.choice(batches).append(message)
    for n, messages in enumerate(batches):
        m.apply_batch(feed(spark, [relation(1, 1, "items", NOTES), *messages]), n)
    assert rows_of(m.read("public.items")) == want
    assert rows_of(table.read_at_lsn(1 << 40)) == want
    assert m.errors().count() == 0 and m.pending().count() == 0
    assert table.compact() is None or rows_of(m.read("public.items")) == want


def test_horizon_ends_tombstones(spark, tmp_path):
    table, m = one_table(spark, tmp_path, horizon=100)
    m.apply_batch(feed(spark, [relation(1, 1, "items", NOTES), row(10, 1, "insert", t(1, "a", 1)), end(11, 1),
                               row(50, 2, "delete", old=t(1, None, None)), end(51, 2)]), 0)
    kept = spark.read.parquet(*[r["path"] for r in table.live().where("area = 'data'").collect()])
    assert rows_of(kept.select("id", "kind")) == [(1, "delete")]
    m.apply_batch(feed(spark, [row(30, 3, "update", t(1, "before the delete", 2)), end(31, 3), row(140, 4, "insert", t(2, "b", 2)), end(141, 4)]), 1)
    assert rows_of(m.read("public.items")) == [(2, "b", 2)] and m.errors().count() == 0
    m.apply_batch(feed(spark, [row(150, 5, "insert", t(3, "c", 3)), end(160, 5)]), 2)
    m.apply_batch(feed(spark, [row(52, 6, "update", t(1, "too late", 2)), end(53, 6), row(70, 7, "insert", t(4, "d", 4)), end(71, 7)]), 3)
    assert rows_of(m.read("public.items")) == [(2, "b", 2), (3, "c", 3), (4, "d", 4)]
    assert rows_of(m.errors().select("lsn", F.col("reasons")[0])) == [(52, "late_commit")]


def test_redelivered_rows_read_only_files_that_may_hold_them(spark, tmp_path, monkeypatch):
    table, m = one_table(spark, tmp_path)
    for batch in range(5):
        low = 100 * batch + 10
        m.apply_batch(feed(spark, [relation(1, 1, "items", NOTES), row(low, batch, "insert", t(batch, "x", 0)), end(low + 5, batch)]), batch)
    ranges, read = [], MirroredTable._read

    def watched(self, entries, extra, columns=None):
        if extra.startswith("kind"):
            ranges.append([(r["low"], r["high"]) for r in entries])
        return read(self, entries, extra, columns)

    monkeypatch.setattr(MirroredTable, "_read", watched)
    again = feed(spark, [row(110, 1, "insert", t(1, "x", 0)), row(600, 9, "insert", t(9, "y", 0)), end(601, 9), end(115, 1)])
    m.apply_batch(again, 5)
    assert ranges[0] == [(115, 115)]
    monkeypatch.undo()
    assert len(rows_of(m.read("public.items"))) == 6 and table.read_log().count() == 6


def chains(seed):
    """Moves that leave the note out, and what the rows are in the end."""
    rng, lsn, live, transactions = random.Random(seed), 10, {}, []
    for x in range(30):
        messages = []
        for _ in range(rng.randint(1, 5)):
            lsn += 2
            k, free = (rng.choice(sorted(live)) if live else None), rng.randrange(50)
            if k is None or rng.random() < 0.3:
                live[free] = (f"v{lsn}", lsn)
                messages.append(row(lsn, 100 + x, "insert", t(free, f"v{lsn}", lsn)))
            elif rng.random() < 0.15:
                del live[k]
                messages.append(row(lsn, 100 + x, "delete", old=t(k, None, None)))
            elif rng.random() < 0.2:
                live[k] = (None, lsn)
                messages.append(row(lsn, 100 + x, "update", t(k, None, lsn)))
            elif free not in live:
                live[free] = (live.pop(k)[0], lsn)
                messages.append(row(lsn, 100 + x, "update", t(free, "~", lsn), old=t(k, None, None)))
        transactions.append([*messages, end(lsn + 1, 100 + x)])
        lsn += 2
    return transactions, sorted(((k, *v) for k, v in live.items()), key=repr)


@pytest.mark.parametrize("seed, batches, fold_every", [(1, 1, 1), (2, 3, 1), (3, 4, 3)])
def test_moved_rows_keep_what_they_leave_out(spark, tmp_path, seed, batches, fold_every):
    transactions, want = chains(seed)
    table = MirroredTable(spark, str(tmp_path), "public", "items", buckets=2)
    m = Mirror(spark, str(tmp_path), [table], fold_every=fold_every, pending_buckets=2)
    for n in range(batches):
        messages = [x for i, tx in enumerate(transactions) if i * batches // len(transactions) == n for x in tx]
        m.apply_batch(feed(spark, [relation(1, 1, "items", NOTES), *messages]), n)
    assert rows_of(m.read("public.items")) == want
    assert m.errors().count() == 0 and table.errors().count() == 0


def test_moved_row_without_a_value_anywhere(spark, tmp_path):
    table, m = one_table(spark, tmp_path)
    m.apply_batch(feed(spark, [relation(1, 1, "items", NOTES), row(10, 1, "update", t(2, "~", 5), old=t(1, None, None)), end(11, 1)]), 0)
    assert rows_of(m.read("public.items")) == [(2, None, 5)]
    assert [(json.loads(r["key"]), r["missing"], r["reason"]) for r in table.errors().collect()] == [
        ({"id": 2}, ["note"], "unchanged_on_key_change")]


def test_chain_of_moves_takes_few_rounds(spark, monkeypatch):
    frozen, keep = [], state.freeze
    monkeypatch.setattr(state, "freeze", lambda df: frozen.append(1) or keep(df))
    rows = [("insert", 0, None, "first", "t", 1)] + [("update", i, i - 1, None, "u", i + 1) for i in range(1, 65)]
    log = spark.createDataFrame([(k, i, o, v, f, n, n, 0) for k, i, o, v, f, n in rows],
                                "kind string, id long, old_id long, v string, v_f string, commit_lsn long, lsn long, seq int")
    split = state.explode_key_change(log, ["id"], origin="was")
    done = state.inherit(split, ["id"], ["v"], "was")
    assert {(r["id"], r["v"]) for r in done.where("kind = 'update'").collect()} == {(i, "first") for i in range(1, 65)}
    assert len(frozen) <= 3 + 8 + 1


def test_copied_rows_give_way_to_the_feed(spark, tmp_path):
    table, m = one_table(spark, tmp_path)
    copied = spark.createDataFrame([(i, f"copy {i}", 0) for i in range(6)], "id long, note string, n int")
    assert m.load_base("public.items", copied.where("id < 3"), 5, "a", keys=["id"]) == 3
    assert rows_of(m.read("public.items")) == [(i, f"copy {i}", 0) for i in range(3)]
    m.apply_batch(feed(spark, [
        relation(1, 1, "items", NOTES), row(10, 1, "update", t(1, "~", 7)), row(11, 1, "delete", old=t(4, None, None)),
        row(12, 1, "update", t(5, "~", 8)), row(13, 1, "update", t(3, "changed", 9)), end(14, 1)]), 0)
    assert m.load_base("public.items", copied.where("id >= 3"), 6, "b") == 3
    assert m.load_base("public.items", copied.where("id >= 3"), 6, "b") == 0
    m.apply_batch(feed(spark, [row(20, 2, "update", t(0, "~", 1)), end(21, 2)]), 1)
    assert rows_of(m.read("public.items")) == [(0, "copy 0", 1), (1, "copy 1", 7), (2, "copy 2", 0), (3, "changed", 9), (5, "copy 5", 8)]
    short = Mirror(spark, str(tmp_path), [MirroredTable(spark, str(tmp_path), "public", "items", horizon=10)])
    with pytest.raises(ValueError, match="horizon"):
        short.load_base("public.items", copied, 6, "c")


def test_a_table_that_fails_does_not_stop_the_others(spark, tmp_path, monkeypatch):
    tables = [MirroredTable(spark, str(tmp_path), "public", n, buckets=2) for n in ("good", "bad")]
    m = Mirror(spark, str(tmp_path), tables, pending_buckets=2, keep_going=True)
    append = MirroredTable.append

    def fails(table, *args, **options):
        if table.name == "bad":
            raise RuntimeError("no space")
        return append(table, *args, **options)

    monkeypatch.setattr(MirroredTable, "append", fails)
    described = [relation(1, 1, "good", NOTES), relation(2, 2, "bad", NOTES)]
    m.apply_batch(feed(spark, [*described, row(3, 1, "insert", t(1, "a", 1)), row(4, 1, "insert", t(2, "b", 2), rid=2), end(5, 1)]), 0)
    m.apply_batch(feed(spark, [row(6, 2, "update", t(2, "~", 3), rid=2), end(7, 2)]), 1)
    assert rows_of(m.read("public.good")) == [(1, "a", 1)] and m.read("public.bad") is None
    assert rows_of(m.failures().select("table_name", "batch", "rows")) == [("public.bad", 0, 1), ("public.bad", 1, 1)]
    assert "no space" in m.failures().first()["error"]
    monkeypatch.setattr(MirroredTable, "append", append)
    m.apply_batch(feed(spark, [row(8, 3, "insert", t(4, "d", 4)), end(9, 3)]), 2)
    assert rows_of(m.read("public.bad")) == [(2, "b", 3)] and rows_of(m.read("public.good")) == [(1, "a", 1), (4, "d", 4)]
    m.apply_batch(feed(spark, [row(10, 4, "delete", old=t(2, None, None), rid=2), end(11, 4)]), 3)
    assert rows_of(m.read("public.bad")) == []


def test_fold_is_due_by_share_of_the_state(spark, tmp_path):
    table = MirroredTable(spark, str(tmp_path), "public", "items", buckets=2)
    m = Mirror(spark, str(tmp_path), [table], pending_buckets=2, fold_share=0.9)
    many = [row(10 + i, 1, "insert", t(i, "%040x" % random.Random(i).getrandbits(160), i)) for i in range(500)]
    m.apply_batch(feed(spark, [relation(1, 1, "items", NOTES), *many, end(600, 1)]), 0)
    m.apply_batch(feed(spark, [row(700, 2, "insert", t(9999, "few", 1)), end(701, 2)]), 1)
    folds = [(r["snapshot_id"], r["folded_through"]) for r in table.snapshots().orderBy("snapshot_id").collect()]
    assert folds == [(1000, 1000), (2000, 1000)]
    assert m.read("public.items").count() == 501


def test_broken_json_lines_are_counted(spark, tmp_path):
    good = json.dumps({"lsn": 5, "seq": 0, "xid": 1, "kind": "begin"})
    (tmp_path / "feed").mkdir()
    for i in range(2):
        (tmp_path / "feed" / f"{i}.json").write_text("\n".join([good, "{broken", "", "{broken", '{"lsn": 7}', ""]))
    for start in (0, 6):
        changes = read_changes(spark, str(tmp_path / "feed"), format="json", start=start)
        kinds = sorted((r["kind"], r["count"]) for r in changes.dropDuplicates(["lsn", "seq"]).groupBy("kind").count().collect())
        assert kinds == [("begin", 1), ("malformed", 6)][start > 0:]
    m = Mirror(spark, str(tmp_path / "m"), [MirroredTable(spark, str(tmp_path / "m"), "public", "items", buckets=2)])
    m.run(read_changes(spark, str(tmp_path / "feed"), format="json", streaming=True))
    assert sorted(r["reasons"][1] for r in m.errors().collect()) == ['{"lsn": 7}'] * 2 + ["{broken"] * 4
    assert read_log(spark, str(tmp_path / "none"), ERRORS).count() == 0


def test_column_added_again_is_another_column(spark, tmp_path):
    table, m = one_table(spark, tmp_path)
    without, other = [("id", 20, True), ("n", 23, False)], [("id", 20, True), ("n", 20, False), ("note", 23, False)]
    m.apply_batch(feed(spark, [relation(1, 1, "items", NOTES), row(2, 1, "insert", t(1, "old", 1)), row(3, 1, "insert", t(2, "old", 2)), end(4, 1)]), 0)
    m.apply_batch(feed(spark, [relation(5, 1, "items", without), row(6, 2, "update", t(1, 3)), end(7, 2)]), 1)
    assert rows_of(m.read("public.items")) == [(1, "old", 3), (2, "old", 2)]
    m.apply_batch(feed(spark, [relation(8, 1, "items", other), row(9, 3, "insert", t(4, 1 << 40, 77)), end(10, 3),
                               row(11, 4, "update", t(2, 5, None)), end(12, 4)]), 2)
    want = [(1, None, 3), (2, None, 5), (4, 77, 1 << 40)]
    assert rows_of(m.read("public.items")) == want
    assert table.compact() is not None and rows_of(m.read("public.items")) == want
    assert rows_of(table.read_at_lsn(12)) == want
    again = Mirror(spark, str(tmp_path), [MirroredTable(spark, str(tmp_path), "public", "items")])
    again.apply_batch(feed(spark, [row(13, 5, "delete", old=t(1, None, None)), end(14, 5)]), 3)
    assert rows_of(again.read("public.items")) == want[1:]


@pytest.mark.parametrize("bad_values", ["cell", "row", "fail"])
def test_bad_values(spark, tmp_path, bad_values):
    table, m = one_table(spark, tmp_path, bad_values=bad_values)
    m.apply_batch(feed(spark, [relation(1, 1, "items", NOTES), row(2, 1, "insert", t(1, "a", 1)), end(3, 1)]), 0)
    bad = feed(spark, [row(4, 2, "update", t(1, "b", "many")), row(5, 2, "insert", t("key", "c", 2)), row(6, 2, "insert", t(3, "d", 3)), end(7, 2)])
    if bad_values == "fail":
        with pytest.raises(ValueError, match="undecodable"):
            m.apply_batch(bad, 1)
        assert rows_of(m.read("public.items")) == [(1, "a", 1)]
        return
    m.apply_batch(bad, 1)
    assert rows_of(m.read("public.items")) == [(1, *(("b", None) if bad_values == "cell" else ("a", 1))), (3, "d", 3)]
    assert rows_of(m.errors().select("lsn", F.col("reasons")[0])) == [(4, "bad_value:n"), (5, "bad_value:id")]


def test_a_table_that_cannot_be_compacted(spark, tmp_path):
    for name in ("broken", "whole"):
        (tmp_path / name / "metadata").mkdir(parents=True)
        (tmp_path / name / "metadata" / "v1").write_text("one")
        for i in range(3):
            spark.createDataFrame([(i,)], "id int").coalesce(1).write.mode("append").parquet(str(tmp_path / name / "data"))
    (tmp_path / "broken" / "data" / "part-x.parquet").write_bytes(b"no file of this kind")
    totals = maintenance.compact(spark, str(tmp_path)).first()
    assert (totals["tables_processed"], totals["files_compacted"]) == (1, 3)
    assert [r["table_dir"].rsplit("/", 1)[1] for r in maintenance.compaction_errors(spark, str(tmp_path)).collect()] == ["broken"]
    assert maintenance.table_files(spark, str(tmp_path / "whole")).count() == 1


@pytest.mark.parametrize("fold_every", [1, 2])
def test_partitioned_state(spark, tmp_path, fold_every):
    spec = [PartitionField("note", "truncate", "first", 1), PartitionField("n", "truncate", "tens", 10)]
    table = MirroredTable(spark, str(tmp_path), "public", "items", buckets=2, partition=spec)
    m = Mirror(spark, str(tmp_path), [table], fold_every=fold_every, pending_buckets=2)
    m.apply_batch(feed(spark, [relation(1, 1, "items", NOTES), *(row(2 + i, 1, "insert", t(i, "ab"[i % 2] + "x", i)) for i in range(40)), end(50, 1)]), 0)
    m.apply_batch(feed(spark, [row(60, 2, "update", t(3, "c", 35)), row(61, 2, "update", t(4, None, 4)), end(62, 2)]), 1)
    m.apply_batch(feed(spark, [row(70, 3, "delete", old=t(5, None, None)), end(71, 3)]), 2)
    want = {i: ("ab"[i % 2] + "x", i) for i in range(40) if i != 5} | {3: ("c", 35), 4: (None, 4)}
    assert rows_of(m.read("public.items")) == sorted(((k, v, n, v and v[0], n - n % 10) for k, (v, n) in want.items()), key=repr)
    part = m.read("public.items").where("first = 'c' and tens = 30")
    assert [r["id"] for r in part.collect()] == [3]
    if fold_every == 1:
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(first" in plan
