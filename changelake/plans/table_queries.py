"""Queries over tables, files, text tuples, logs, and plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelake.functions.lsn import format_lsn, parse_lsn
from changelake.functions.partitioning import PartitionField, partition_by
from changelake.operators import compaction, decode, monitor, relational, relations, snapshots
from changelake.plans import feeds
from changelake.plans.feeds import FILES, LISTING, check
from changelake.plans.registry import query
from changelake.session import TASK_ROWS, parts_for, scratch_path
from changelake.sources import inventory
from changelake.sources.logs import qualified


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- partition transforms -------------------------------------------------------------------

def _partition_counts(spark, sf, name, field, value="cast({} as string)"):
    split = partition_by(table(spark, sf, name), [field])
    return split.groupBy(F.expr(value.format(field.name)).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("select cast(year(o_orderdate) as varchar) part, count(*) n from orders group by all")
def partition_year(spark, sf):
    return _partition_counts(spark, sf, "orders", PartitionField("o_orderdate", "year", "p"))


@query("select cast(cast(date_trunc('month', o_orderdate) as date) as varchar) part, count(*) n from orders group by all")
def partition_month(spark, sf):
    return _partition_counts(spark, sf, "orders", PartitionField("o_orderdate", "month", "p"))


@query("select cast(cast(l_shipdate as date) as varchar) part, count(*) n from lineitem group by all")
def partition_day(spark, sf):
    return _partition_counts(spark, sf, "lineitem", PartitionField("l_shipdate", "day", "p"))


@query("select cast(l_partkey - l_partkey % 50 as varchar) part, count(*) n from lineitem group by all")
def partition_truncate(spark, sf):
    return _partition_counts(spark, sf, "lineitem", PartitionField("l_partkey", "truncate", "p", 50))


@query("select substr(o_orderpriority, 1, 3) part, count(*) n from orders group by all")
def partition_truncate_text(spark, sf):
    return _partition_counts(spark, sf, "orders", PartitionField("o_orderpriority", "truncate", "p", 3))


@query("select o_custkey, 1 buckets, count(*) n from orders group by o_custkey")
def partition_bucket(spark, sf):
    """The hash is Spark's own; what can be checked is that a key has one bucket, within range."""
    split = partition_by(table(spark, sf, "orders"), [PartitionField("o_custkey", "bucket", "p", 16)])
    return split.groupBy("o_custkey").agg(
        ((F.min("p") == F.max("p")) & (F.min("p") >= 0) & (F.max("p") < 16)).cast("int").alias("buckets"),
        F.count(F.lit(1)).alias("n"))


# --- positions and text tuples --------------------------------------------------------------

@query("select o_orderkey, o_custkey * 4294967296 + o_orderkey * 4099 lsn, true same from orders")
def lsn_parse(spark, sf):
    text = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "concat(hex(o_custkey), '/', hex(o_orderkey * 4099)) txt")
    return text.select("o_orderkey", parse_lsn("txt").alias("lsn"),
                       (format_lsn(parse_lsn("txt")) == F.col("txt")).alias("same"))


def _columns(*columns):
    entries = ", ".join(f"named_struct('name', '{n}', 'oid', {oid}L, 'typmod', {mod}, 'is_key', {key})"
                        for n, oid, mod, key in columns)
    return f"array({entries})"


def _cell(value, kind="'t'"):
    return f"named_struct('f', {kind}, 'v', {value})"


EVENT_COLUMNS = _columns(("event_id", 20, -1, "true"), ("ts", 1114, -1, "false"), ("user_id", 20, -1, "false"),
                         ("event_type", 25, -1, "false"), ("value", 701, -1, "false"), ("props", 25, -1, "false"))


def _events(spark, sf):
    """Events as text tuples: errors carry a damaged number, sign-ups lack their user."""
    cells = [
        _cell("cast(event_id as string)"), _cell("cast(ts as string)"),
        _cell("if(event_type = 'signup', null, cast(user_id as string))", "if(event_type = 'signup', 'n', 't')"),
        _cell("event_type"), _cell("if(event_type = 'error', concat('x', value), cast(value as string))"),
        _cell("if(event_type = 'view', null, props)", "if(event_type = 'view', 'u', 't')")]
    rows = table(spark, sf, "events").selectExpr(
        "event_id * 16 + 1 lsn", "0 seq", "event_id xid", "event_id sub_xid",
        "if(event_type = 'view', 'update', 'insert') kind", "7L relation_id",
        f"array({', '.join(cells)}) new_cols", "cast(null as array<struct<f: string, v: string>>) old_cols")
    return _bound(spark, rows, "events", EVENT_COLUMNS, ["user_id", "ts"])


def _bound(spark, rows, name, columns, required=()):
    message = spark.sql(f"""select 0L lsn, 0 seq, 7L relation_id, 'relation' kind,
        named_struct('namespace', 'public', 'name', '{name}', 'columns', {columns}) relation""")
    versions = relations.relation_versions(message)
    shape = relations.TableShape.of(versions, "public", name, required)
    return decode.to_columns(decode.bind(rows, versions, shape), shape)


@query("""select event_id, ts, user_id, event_type, value, case when event_type <> 'view' then props end props,
          case when event_type = 'view' then 'u' else 't' end props_f
          from events where event_type not in ('error', 'signup')""")
def typed_decode(spark, sf):
    return decode.fit(_events(spark, sf)).select(
        "event_id", "ts", "user_id", "event_type", "value", "props", "props_f")


@query("""select event_id * 16 + 1 lsn,
          case event_type when 'error' then 'bad_value:value' else 'not_null:user_id' end reasons
          from events where event_type in ('error', 'signup')""")
def decode_quarantine(spark, sf):
    return decode.quarantine(_events(spark, sf)).select("lsn", F.array_join("reasons", ",").alias("reasons"))


@query("""select case event_type when 'error' then 'bad_value:value' else 'not_null:user_id' end reason,
          count(*) errors from events where event_type in ('error', 'signup') group by all""")
def error_counts(spark, sf):
    return monitor.error_counts(decode.quarantine(_events(spark, sf)))


LINE_COLUMNS = _columns(
    ("l_orderkey", 20, -1, "true"), ("l_linenumber", 21, -1, "true"), ("l_partkey", 23, -1, "false"),
    ("qty", 1700, (12 << 16 | 2) + 4, "false"), ("price", 1700, -1, "false"), ("discount", 701, -1, "false"),
    ("tax", 700, -1, "false"), ("flag", 1042, -1, "false"), ("open", 16, -1, "false"), ("day", 1082, -1, "false"),
    ("shipped", 1184, -1, "false"), ("raw", 17, -1, "false"), ("packed", 17, -1, "false"), ("other", 3802, -1, "false"))


@query("""select l_orderkey, l_linenumber, cast(l_partkey as integer) l_partkey, l_quantity qty, l_discount discount,
          cast(cast(l_tax as float) as double) tax, concat(l_returnflag, ' ') flag, l_linestatus = 'O' as open,
          cast(l_shipdate as date) "day", epoch_us(l_shipdate) - 7200000000 shipped,
          l_linestatus raw, l_returnflag packed, concat('{"k":', l_linenumber, '}') other,
          cast(l_suppkey as varchar) price from lineitem""")
def typed_decode_types(spark, sf):
    """Every source type: integers, numeric with and without modifier, floats, padded text,
    boolean, date, zoned timestamp, bytea as text and as binary, and an unknown type."""
    cells = [_cell(x) for x in (
        "cast(l_orderkey as string)", "cast(l_linenumber as string)", "cast(l_partkey as string)",
        "cast(cast(l_quantity as decimal(12, 2)) as string)", "cast(l_suppkey as string)",
        "cast(l_discount as string)", "cast(l_tax as string)", "concat(l_returnflag, ' ')",
        "if(l_linestatus = 'O', 't', 'f')", "cast(cast(l_shipdate as date) as string)",
        "concat(cast(l_shipdate as string), '+02')", "concat('\\\\x', lower(hex(l_linestatus)))")]
    cells += [_cell("hex(l_returnflag)", "'b'"), _cell("concat('{\"k\":', l_linenumber, '}')")]
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 16 + l_linenumber lsn", "0 seq", "l_orderkey xid", "l_orderkey sub_xid", "'insert' kind",
        "7L relation_id", f"array({', '.join(cells)}) new_cols",
        "cast(null as array<struct<f: string, v: string>>) old_cols")
    typed = decode.fit(_bound(spark, rows, "lines", LINE_COLUMNS))
    return typed.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("qty").cast("double").alias("qty"), "discount",
        F.col("tax").cast("double").alias("tax"), "flag", "open", "day", F.unix_micros("shipped").alias("shipped"),
        F.col("raw").cast("string").alias("raw"), F.col("packed").cast("string").alias("packed"), "other", "price")


@query("""select o_orderkey, 'o_totalprice' missing from orders where o_orderstatus = 'P' and o_orderpriority <> '1-URGENT'
          union all select o_orderkey, 'o_custkey' from orders where o_orderstatus <> 'P' and o_orderpriority = '1-URGENT'
          union all select o_orderkey, 'o_totalprice,o_custkey' from orders
          where o_orderstatus = 'P' and o_orderpriority = '1-URGENT'""")
def not_null_violations(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "if(o_orderstatus = 'P', null, o_totalprice) o_totalprice",
        "if(o_orderpriority = '1-URGENT', null, o_custkey) o_custkey")
    bad = decode.not_null_violations(rows, ["o_totalprice", "o_custkey"])
    return bad.select("o_orderkey", F.array_join("missing", ",").alias("missing"))


# --- files and snapshots --------------------------------------------------------------------

def _files(spark, sf):
    """Each order's files in one of as many parts as the order lines need, so that no task's share grows with them."""
    lines = table(spark, sf, "lineitem")
    parts = parts_for(lines)
    files = spark.sql(f"with {FILES} select * from files", lineitem=lines.repartition(parts, "l_orderkey"))
    return files.repartition(parts, "table_name")


@query(check(FILES, """
    select table_name, snapshot_id, coalesce(lag(snapshot_id) over (partition by table_name order by snapshot_id), 0)
    parent_snapshot_id from (select distinct table_name, snapshot_id from files) x"""))
def snapshot_chain(spark, sf):
    known = _files(spark, sf).select("table_name", "snapshot_id", F.col("snapshot_id").alias("sequence")).distinct()
    return snapshots.snapshot_chain(known).select("table_name", "snapshot_id", "parent_snapshot_id")


@query(check(FILES, """
    select table_name, snapshot_id, added_files, added_records,
           cast(sum(d_files) over w as bigint) total_files, cast(sum(d_records) over w as bigint) total_records
    from (select table_name, snapshot_id, count(*) filter (where status = 1) added_files,
                 cast(coalesce(sum(record_count) filter (where status = 1), 0) as bigint) added_records,
                 sum(case status when 1 then 1 else -1 end) d_files,
                 sum(case status when 1 then record_count else -record_count end) d_records
          from files group by table_name, snapshot_id) x
    window w as (partition by table_name order by snapshot_id)"""))
def snapshot_summary(spark, sf):
    return snapshots.snapshot_summary(_files(spark, sf))


# Each column, and how its bounds are written: adding 0 makes a negative zero an ordinary one.
BOUNDS = {c: c for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus",
                         "l_shipdate")} | {c: f"{c} + 0" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
YEARS = "f as (select concat('y', cast(year(l_shipdate) as varchar(20))) path, lineitem.* from lineitem)"


def _by_year(spark, sf):
    path = F.concat(F.lit("y"), F.year("l_shipdate").cast("string"))
    return table(spark, sf, "lineitem").withColumn("path", path)


@query(f"with {YEARS} " + " union all ".join(
    f"select path, '{c}' column_name, count({c}) value_count, count(*) - count({c}) null_count, "
    f"cast(min({x}) as varchar) \"lower\", cast(max({x}) as varchar) \"upper\" from f group by path"
    for c, x in BOUNDS.items()))
def column_metrics(spark, sf):
    """Every column; ship years stand for files."""
    return snapshots.column_metrics(_by_year(spark, sf), "path")


@query(" union all ".join(
    f"select '{c}' column_name, count({c}) value_count, count(*) - count({c}) null_count, "
    f"cast(min({x}) as varchar) \"lower\", cast(max({x}) as varchar) \"upper\" from lineitem"
    for c, x in BOUNDS.items()))
def file_metrics(spark, sf):
    """The same per real data file; the given table is one file."""
    return snapshots.file_metrics(table(spark, sf, "lineitem")).drop("path")


@query("with f as (select l_suppkey, l_returnflag, l_linestatus, min(l_extendedprice) lo, max(l_extendedprice) hi "
       "from lineitem group by all) select concat(l_suppkey, '/', l_returnflag, l_linestatus) path from f "
       "where hi >= 104500 and lo <= 104900")
def prune_files(spark, sf):
    """Supplier and flags stand for files; which may hold a price in the range?"""
    path = F.concat(F.col("l_suppkey").cast("string"), F.lit("/"), F.col("l_returnflag"), F.col("l_linestatus"))
    metrics = snapshots.column_metrics(
        table(spark, sf, "lineitem").withColumn("path", path), "path", ["l_extendedprice"])
    return snapshots.prune_files(metrics, "l_extendedprice", 104500.0, 104900.0, "double")


def _listing(spark, sf):
    return feeds.run(spark, sf, LISTING, "select * from listing")


PLAN_COUNT = LISTING + """, numbered as (
  select *, cast(floor((row_number() over (partition by dir order by path) - 1) / 5.0) as bigint) grp from listing),
sizes as (select dir, grp, count(*) n from numbered group by dir, grp),
plan as (select numbered.* from numbered join sizes on numbered.dir = sizes.dir and numbered.grp = sizes.grp where n >= 2)"""


@query(check(PLAN_COUNT, "select dir, path, length, grp from plan"))
def compaction_plan_count(spark, sf):
    return compaction.plan_by_count(_listing(spark, sf), 5)


@query(check(LISTING + """, placed as (
  select *, cast(floor((sum(length) over (partition by dir order by path rows unbounded preceding) - length) / 100000.0)
    as bigint) grp from listing where length < 100000),
  sizes as (select dir, grp, count(*) n from placed group by dir, grp)""",
             "select placed.* from placed join sizes on placed.dir = sizes.dir and placed.grp = sizes.grp where n >= 2"))
def compaction_plan_bytes(spark, sf):
    return compaction.plan_by_bytes(_listing(spark, sf), 100000)


@query(check(PLAN_COUNT, """
    select dir, grp, count(*) files_before, cast(sum(length) as bigint) bytes_before, 1 files_after,
           cast(floor(sum(length) / 2.0) as bigint) bytes_after,
           cast(sum(length) - floor(sum(length) / 2.0) as bigint) bytes_saved from plan group by dir, grp"""))
def compaction_stats(spark, sf):
    """Savings per group, for outputs of half the size."""
    plan = compaction.plan_by_count(_listing(spark, sf), 5)
    written = plan.groupBy("dir", "grp").agg(
        F.expr("sum(length) div 2").alias("bytes"), F.lit(1).alias("record_count"), F.lit("out").alias("path"))
    return compaction.compaction_stats(plan, written).drop("rows").withColumn(
        "files_after", F.col("files_after").cast("int"))


@query("select * from lineitem")
def compaction_rows_preserved(spark, sf):
    """All rows of a table after its files were merged."""
    source, out = scratch_path(spark, "small"), scratch_path(spark, "merged")
    lines = table(spark, sf, "lineitem")
    lines.repartition(max(12, -(-lines.count() // TASK_ROWS))).write.parquet(source)
    files = inventory.file_inventory(spark, source)
    compaction.rewrite(spark, compaction.plan_by_count(files), out)
    merged = spark.read.option("recursiveFileLookup", "true").parquet(out)
    planned = compaction.plan_by_count(files).select(compaction.listed_path(F.col("path")).alias("path"))
    rest = files.withColumn("path", compaction.listed_path(F.col("path"))).join(planned, "path", "left_anti")
    alone = compaction.paths_of(rest)
    return merged.unionByName(spark.read.parquet(*alone)) if alone else merged


# --- monitoring -----------------------------------------------------------------------------

@query("""select cast(le as double) le, (select count(*) from events where value <= le) at_most,
                 (select cast(sum(cast(value as decimal(18, 2))) as double) from events) sum_seconds,
                 (select count(value) from events) queries
          from (values (0.005), (0.01), (0.025), (0.05), (0.1), (0.25), (0.5), (1.0), (2.5), (5.0), (10.0)) b(le)
          union all select cast('infinity' as double), count(value),
                 cast(sum(cast(value as decimal(18, 2))) as double), count(value) from events""")
def duration_histogram(spark, sf):
    """Event values as seconds; the last bound is infinity."""
    log = table(spark, sf, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    lines = monitor.duration_histogram(log, "value")
    return lines.select("le", "at_most", F.col("sum_seconds").cast("double").alias("sum_seconds"), "queries")


@query("select event_id, event_type, value from events where value * 1000 >= 100000")
def slow_queries(spark, sf):
    return monitor.slow_queries(table(spark, sf, "events"), "value", 100000).select("event_id", "event_type", "value")


@query("select event_type, count(*) queries from events group by event_type")
def query_counts(spark, sf):
    return monitor.query_counts(table(spark, sf, "events"), "event_type")


STATUS = "case when value >= 200 then 'unhealthy' when value >= 100 then 'degraded' else 'healthy' end"


def _checks(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "concat('user', user_id) component", f"{STATUS} status", "props message", "ts checked_at", "event_id check_id")


@query(f"""select component, case max(r) when 2 then 'unhealthy' when 1 then 'degraded' else 'healthy' end status,
           count(*) checks
           from (select concat('user', user_id) component, case {STATUS} when 'unhealthy' then 2
                        when 'degraded' then 1 else 0 end r from events) x group by component""")
def status_rollup(spark, sf):
    return monitor.status_rollup(_checks(spark, sf), ["component"])


@query(f"""select component, status, message, checked_at from (
             select concat('user', user_id) component, {STATUS} status, props message, ts checked_at,
                    row_number() over (partition by user_id order by ts desc, event_id desc) n from events) x where n = 1""")
def latest_status(spark, sf):
    return monitor.latest_status(_checks(spark, sf))


@query(f"""select case max(r) when 2 then 'unhealthy' when 1 then 'degraded' else 'healthy' end status, count(*) checks
           from (select case {STATUS} when 'unhealthy' then 2 when 'degraded' then 1 else 0 end r,
                        row_number() over (partition by user_id order by ts desc, event_id desc) n from events) x
           where n = 1""")
def overall_status(spark, sf):
    """Worst of the newest result of every component."""
    return monitor.status_rollup(monitor.latest_status(_checks(spark, sf)))


@query("""select count(*) runs, cast(sum(l_quantity) as bigint) files_processed, cast(sum(l_quantity) as bigint) files_compacted,
          cast(sum(l_partkey) as bigint) bytes_saved, cast(sum(l_linenumber) as double) "seconds" from lineitem""")
def compaction_totals(spark, sf):
    """Order lines as rows of the compaction log."""
    runs = table(spark, sf, "lineitem").selectExpr(
        "cast(l_quantity as bigint) files_processed", "cast(l_quantity as bigint) files_compacted",
        "l_partkey bytes_saved", "cast(l_linenumber as double) seconds")
    return monitor.compaction_totals(runs)


# --- SQL over tables ------------------------------------------------------------------------

@query("""select c_name, o_totalprice, o_orderstatus from customer join orders on c_custkey = o_custkey""")
def join_two(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.expr("c_custkey = o_custkey")).select(
        "c_name", "o_totalprice", "o_orderstatus")


@query("""select c_name, p_name, l_quantity, o_totalprice, o_orderstatus from orders
          join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey
          join part on l_partkey = p_partkey where o_orderstatus = 'F' order by o_totalprice desc""")
def join_three(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return (table(spark, sf, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey"))
            .join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
            .join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
            .select("c_name", "p_name", "l_quantity", "o_totalprice", "o_orderstatus")
            .orderBy(F.desc("o_totalprice")))


@query("""select o_orderkey, o_totalprice, o_orderstatus from orders
          where o_custkey = 7 and o_orderstatus = 'F' and o_totalprice >= 1000""")
def point_lookup_param(spark, sf):
    view = "orders_lookup"
    relational.register({view: table(spark, sf, "orders")})
    return relational.query(spark, f"""select o_orderkey, o_totalprice, o_orderstatus from {view}
        where o_custkey = :customer and o_orderstatus = :status and o_totalprice >= :least""",
        {"customer": 7, "status": "F", "least": 1000.0})


@query("""select l_orderkey, l_linenumber, l_partkey from lineitem
          where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'P')""")
def orphans(spark, sf):
    """Order lines whose order is missing, after pending orders were taken out."""
    kept = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return relational.orphans(table(spark, sf, "lineitem"), kept, [("l_orderkey", "o_orderkey")]).select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("select count(*) n from lineitem")
def count_all(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("select cast(sum(cast(o_totalprice as decimal(18, 2))) as double) total from orders")
def sum_total(spark, sf):
    return table(spark, sf, "orders").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("select o_orderstatus, count(*) order_count from orders group by o_orderstatus order by order_count desc")
def group_count(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("order_count")).orderBy(F.desc("order_count"))


@query("""select o_orderstatus, count(*) n, cast(sum(cast(o_totalprice as decimal(18, 2))) as double) / count(*) avg_total
          from orders group by o_orderstatus""")
def group_count_avg(spark, sf):
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), (total / F.count(F.lit(1))).alias("avg_total"))
