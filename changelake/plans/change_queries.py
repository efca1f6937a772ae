"""Queries over the derived feeds: transactions, state, history, relations, monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from changelake.operators import monitor, relations, state, transactions
from changelake.plans import feeds
from changelake.plans.feeds import CATALOG, COMMITTED, CUSTOMER_FEED, MARKERS, ORDERS_FEED, RELATIONS, check
from changelake.plans.registry import query
from changelake.sources import catalog
from changelake.sources.envelope import select_tables as pick_tables

COLUMNS = ["st", "tp", "pr"]
AS_OF = 3200 * feeds.DAY
ORDERS_LOG = f"{ORDERS_FEED},{MARKERS},{COMMITTED}"

STATE = """
last as (
  select k, kind, row_number() over (partition by k order by commit_lsn desc, lsn desc, seq desc) n
  from {log}),
s as (select * from (select k, st, row_number() over (
  partition by k order by commit_lsn desc, lsn desc) n from {log} where st_f <> 'u') x where n = 1),
t as (select * from (select k, tp, row_number() over (
  partition by k order by commit_lsn desc, lsn desc) n from {log} where tp_f <> 'u') x where n = 1),
p as (select * from (select k, pr, row_number() over (
  partition by k order by commit_lsn desc, lsn desc) n from {log} where pr_f <> 'u') x where n = 1),
state as (
  select last.k, s.st, t.tp, p.pr from last left join s on last.k = s.k
  left join t on last.k = t.k left join p on last.k = p.k where last.n = 1 and last.kind <> 'delete')"""
ORDERS_STATE = ORDERS_LOG + "," + STATE.replace("{log}", "committed")


def orders_log(spark, sf):
    return transactions.committed(feeds.orders_changes(spark, sf))


def orders_state(spark, sf):
    return state.current_state(orders_log(spark, sf), ["k"], COLUMNS, COLUMNS)


@query(check(ORDERS_STATE, "select * from state"))
def current_state(spark, sf):
    return orders_state(spark, sf)


BY_STATUS = """select st, count(*) orders, cast(sum(cast(tp as decimal(18, 2))) as double) total,
    cast(sum(cast(tp as decimal(18, 2))) as double) / count(tp) avg_total from {state} group by st"""


@query(check(ORDERS_STATE, BY_STATUS.replace("{state}", "state")))
def state_group_avg(spark, sf):
    """The flagship: feed to state to SQL."""
    return spark.sql(BY_STATUS, state=orders_state(spark, sf))


@query(check(ORDERS_LOG + f", upto as (select * from committed where commit_lsn <= {AS_OF}),"
             + STATE.replace("{log}", "upto"), "select * from state"))
def current_state_as_of(spark, sf):
    return state.state_as_of(orders_log(spark, sf), AS_OF, ["k"], COLUMNS, COLUMNS)


@query(check(ORDERS_LOG, """select k, kind, lsn, commit_lsn, lead(lsn) over (
    partition by k order by commit_lsn, lsn, seq) valid_to from committed"""))
def history(spark, sf):
    return state.history(orders_log(spark, sf), ["k"]).select("k", "kind", "lsn", "commit_lsn", "valid_to")


@query(check(ORDERS_FEED, "select k, kind, lsn, xid from feed where fate = 'abort' or sub_fate = 'abort'"))
def aborted_excluded(spark, sf):
    return transactions.rolled_back(feeds.orders_changes(spark, sf)).select("k", "kind", "lsn", "xid")


@query(check(ORDERS_FEED, "select k, kind, lsn, xid from feed where fate = 'open' and sub_fate <> 'abort'"))
def pending_rows(spark, sf):
    return transactions.pending(feeds.orders_changes(spark, sf)).select("k", "kind", "lsn", "xid")


@query(check(ORDERS_LOG, "select xid, commit_lsn, count(*) changes from committed group by xid, commit_lsn"))
def committed_transactions(spark, sf):
    return orders_log(spark, sf).groupBy("xid", "commit_lsn").agg(F.count(F.lit(1)).alias("changes"))


@query(check(ORDERS_FEED, "select lsn, k, kind, st, tp, pr from feed"))
def redelivery_dedupe(spark, sf):
    once = feeds.run(spark, sf, ORDERS_FEED, "select * from feed")
    again = feeds.run(spark, sf, ORDERS_FEED, "select * from feed where kind = 'update'")
    return transactions.deduplicate(once.unionByName(again)).select("lsn", "k", "kind", "st", "tp", "pr")


@query(check(ORDERS_LOG + """, base as (
    select o_orderkey k, cast('B' as varchar(20)) st, 't' st_f, o_totalprice tp, 't' tp_f, o_orderpriority pr, 't' pr_f,
           'insert' kind, cast(0 as bigint) commit_lsn, cast(0 as bigint) lsn, 0 seq from orders),
  log as (select k, st, st_f, tp, tp_f, pr, pr_f, kind, commit_lsn, lsn, seq from committed where kind <> 'insert'
          union all select * from base),""" + STATE.replace("{log}", "log"), "select * from state"))
def base_snapshot_state(spark, sf):
    """A copy of the table from before the feed, then the feed's updates and deletes."""
    changes = orders_log(spark, sf).where("kind <> 'insert'")
    base = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey k", "'B' st", "'t' st_f", "o_totalprice tp", "'t' tp_f", "o_orderpriority pr", "'t' pr_f")
    return state.current_state(transactions.with_base(base, changes), ["k"], COLUMNS, COLUMNS)


SPLIT_CUSTOMERS = """
log as (
  select relation_id, k, 'upsert' kind, nm, nm_f, bal, seg, seg_f, commit_lsn, lsn, seq
  from committed where kind in ('insert', 'update')
  union all
  select relation_id, old_k, 'delete', null, 'n', null, null, 'n', commit_lsn, lsn, seq
  from committed where kind = 'update' and old_k <> k),
cut as (select max(commit_lsn) c from committed where kind = 'truncate'),
kept as (select log.* from log, cut where log.commit_lsn > cut.c),"""
CUSTOMER_STATE = """
last as (select * from (
  select k, kind, bal, row_number() over (partition by k order by commit_lsn desc, lsn desc) n
  from {log}) x where n = 1 and kind <> 'delete'),
a as (select * from (select k, nm, row_number() over (
  partition by k order by commit_lsn desc, lsn desc) n from {log} where nm_f <> 'u') x where n = 1),
b as (select * from (select k, seg, row_number() over (
  partition by k order by commit_lsn desc, lsn desc) n from {log} where seg_f <> 'u') x where n = 1),
state as (select last.k, a.nm, last.bal, b.seg, a.k is null no_nm, b.k is null no_seg
          from last left join a on last.k = a.k left join b on last.k = b.k)"""
CUSTOMERS = ["nm", "bal", "seg"], ["nm", "seg"]


def customers_log(spark, sf):
    log = transactions.committed(feeds.customer_changes(spark, sf))
    return state.explode_key_change(log, ["k"])


@query(check(CUSTOMER_FEED + "," + SPLIT_CUSTOMERS + CUSTOMER_STATE.replace("{log}", "log"),
             "select k, nm, bal, seg from state"))
def key_change(spark, sf):
    log = customers_log(spark, sf).where("kind <> 'truncate'")
    return state.current_state(log, ["k"], *CUSTOMERS)


@query(check(CUSTOMER_FEED + "," + SPLIT_CUSTOMERS + CUSTOMER_STATE.replace("{log}", "kept"),
             "select k, nm, bal, seg from state"))
def truncate_state(spark, sf):
    return state.current_state(state.after_truncate(customers_log(spark, sf)), ["k"], *CUSTOMERS)


@query(check(CUSTOMER_FEED + "," + SPLIT_CUSTOMERS + CUSTOMER_STATE.replace("{log}", "kept"),
             "select k, concat_ws(',', case when no_nm then 'nm' end, case when no_seg then 'seg' end) missing "
             "from state where no_nm or no_seg"))
def unchanged_without_base(spark, sf):
    lost = state.unresolved(state.after_truncate(customers_log(spark, sf)), ["k"], *CUSTOMERS)
    return lost.select("k", F.array_join("missing", ",").alias("missing"))


@query(check(feeds.MOVES_FEED + "," + feeds.MOVES_STATE, "select * from state"))
def key_change_chain(spark, sf):
    """Rows that move three times and leave values out, within transactions and across them."""
    log = transactions.committed(feeds.moves_changes(spark, sf))
    split = state.explode_key_change(log.drop("ch"), ["k"], origin="was")
    return state.current_state(state.inherit(split, ["k"], CUSTOMERS[1], "was"), ["k"], *CUSTOMERS)


@query(check(ORDERS_FEED + "," + MARKERS, """
    select kind, count(*) messages from (select kind from feed union all select kind from markers) x group by kind"""))
def kind_counts(spark, sf):
    return monitor.kind_counts(feeds.orders_changes(spark, sf))


@query(check(ORDERS_FEED + "," + MARKERS, """
    select max(lsn) last_lsn from (select lsn from feed union all select lsn from markers) x"""))
def last_lsn(spark, sf):
    return monitor.last_lsn(feeds.orders_changes(spark, sf))


@query(check(ORDERS_LOG, """
    select feed.relation_id, max(feed.lsn) feed_lsn, max(c.lsn) applied_lsn,
           greatest(max(feed.lsn) - max(c.lsn), 0) lag_bytes
    from feed left join (select relation_id, max(lsn) lsn from committed group by relation_id) c
    on feed.relation_id = c.relation_id group by feed.relation_id"""))
def lag_by_table(spark, sf):
    changes = feeds.orders_changes(spark, sf)
    applied = transactions.committed(changes).groupBy("relation_id").agg(F.max("lsn").alias("max_lsn"))
    return monitor.lag_by_table(changes, applied)


@query(check(ORDERS_LOG, f"""
    select kind, cast(floor(lsn / {float(feeds.DAY)}) as bigint) log_day, count(*) records from committed group by all"""))
def append_log_counts(spark, sf):
    """Records per output of an append-only log."""
    return orders_log(spark, sf).groupBy(
        "kind", F.expr(f"lsn div {feeds.DAY}").alias("log_day")).agg(F.count(F.lit(1)).alias("records"))


@query(check(RELATIONS, """
    select c.k, c.relation_id, m.nm from changes c asof join messages m
    on c.relation_id = m.relation_id and c.lsn >= m.lsn"""))
def relation_asof(spark, sf):
    changes, versions = _relation_feed(spark, sf)
    return relations.bind_relation(changes, versions).select("k", "relation_id", F.col("relation.nm").alias("nm"))


@query(check(feeds.DAILY_RELATION, """
    select c.k, m.nm from changes c asof join messages m on c.relation_id = m.relation_id and c.lsn >= m.lsn"""))
def relation_asof_daily(spark, sf):
    """One relation with a version for every day with orders."""
    changes, versions = _relation_feed(spark, sf, feeds.DAILY_RELATION)
    return relations.bind_relation(changes, versions).select("k", F.col("relation.nm").alias("nm"))


@query(check(RELATIONS + """, shapes as (
    select relation_id, ns, nm, lsn, lag(nm) over (partition by relation_id order by lsn) before from messages)""",
             """select relation_id, nm, lsn valid_from, lead(lsn) over (partition by relation_id order by lsn) valid_to
                from shapes where before is distinct from nm"""))
def relation_versions(spark, sf):
    _, versions = _relation_feed(spark, sf)
    return versions.select("relation_id", F.col("relation.nm").alias("nm"),
                           F.col("valid_from.lsn").alias("valid_from"), F.col("valid_to.lsn").alias("valid_to"))


@query(check(RELATIONS, """
    select c.k, c.relation_id from changes c
    where not exists (select 1 from messages m where m.relation_id = c.relation_id and m.lsn <= c.lsn)"""))
def unknown_relation(spark, sf):
    return relations.unknown_relation(*_relation_feed(spark, sf)).select("k", "relation_id")


def _relation_feed(spark, sf, feed=RELATIONS):
    changes = feeds.run(spark, sf, feed, "select * from changes")
    messages = feeds.run(spark, sf, feed, "select relation_id, lsn, seq, kind, struct(ns, nm) relation from messages")
    return changes, relations.relation_versions(messages)


@query(check(RELATIONS, "select c.k, c.relation_id, c.lsn from changes c join nation on c.relation_id = n_nationkey "
                        "join region on n_regionkey = r_regionkey where r_name in ('EUROPE', 'ASIA')"))
def select_tables(spark, sf):
    """Changes of configured tables: (region, nation) stand for (namespace, name)."""
    changes = feeds.run(spark, sf, RELATIONS, """
        select changes.*, r_name namespace, n_name name from changes
        join {nation} on relation_id = n_nationkey join {region} on n_regionkey = r_regionkey""")
    wanted = [(r.r_name, r.n_name) for r in feeds.run(spark, sf, "x as (select * from {region})", """
        select r_name, n_name from x join {nation} on r_regionkey = n_regionkey
        where r_name in ('EUROPE', 'ASIA')""").collect()]
    return pick_tables(changes, wanted).select("k", "relation_id", "lsn")


@query(check(CATALOG, """
    select table_schema, table_name, column_name, ordinal_position, type_oid, udt_name type_name,
           is_nullable = 'YES' nullable
    from columns join types on udt_name = type_name and udt_schema = type_namespace"""))
def catalog_columns(spark, sf):
    return _catalog(spark, sf)


@query(check(CATALOG, """
    select table_schema, table_name, count(*) n_columns,
           string_agg(concat(column_name, ':', cast(type_oid as varchar(20)), case is_nullable when 'YES' then '?' else '' end),
                      ',' order by ordinal_position) columns
    from columns join types on udt_name = type_name and udt_schema = type_namespace
    group by table_schema, table_name"""))
def catalog_schema(spark, sf):
    text = F.transform("columns", lambda c: F.concat(
        c["name"], F.lit(":"), c["type_oid"].cast("string"), F.when(c["nullable"], "?").otherwise("")))
    return catalog.table_schemas(_catalog(spark, sf)).select(
        "table_schema", "table_name", F.size("columns").cast("bigint").alias("n_columns"),
        F.array_join(text, ",").alias("columns"))


def _catalog(spark, sf):
    return catalog.read_columns(feeds.run(spark, sf, CATALOG, "select * from columns"),
                                feeds.run(spark, sf, CATALOG, "select * from types"))


@query("""select n_name namespace, c_name name, c_custkey relation_id
          from customer join nation on c_nationkey = n_nationkey""")
def relation_ids(spark, sf):
    """Customers stand for tables, nations for namespaces."""
    classes = spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey relation_id", "c_name name", "c_nationkey namespace_oid")
    names = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_nationkey namespace_oid", "n_name namespace")
    return catalog.relation_ids(classes, names)


MESSAGE_COLUMNS = """, msg as (
  select 'public' namespace, concat('t', cast(l_orderkey as varchar(20))) name,
         concat('c', cast(l_linenumber as varchar(20))) column_name, max(l_partkey) type_oid
  from {lineitem} group by l_orderkey, l_linenumber
  union all
  select 'public', concat('t', cast(o_orderkey as varchar(20))), 'added_later', cast(25 as bigint) from {orders}),
known as (
  select table_schema namespace, table_name name, column_name, is_nullable = 'YES' nullable, udt_name type_name
  from columns)"""


@query(check(CATALOG + MESSAGE_COLUMNS, """
    select msg.namespace, msg.name, msg.column_name, type_oid, coalesce(nullable, true) nullable,
           coalesce(type_name, '') type_name
    from msg left join known on msg.namespace = known.namespace and msg.name = known.name
     and msg.column_name = known.column_name"""))
def nullability_merge(spark, sf):
    both = CATALOG + MESSAGE_COLUMNS
    return relations.merge_nullability(feeds.run(spark, sf, both, "select * from msg"),
                                       feeds.run(spark, sf, both, "select * from known"))


@query("""select o_orderkey, o_custkey, cast(null as double) o_totalprice, o_orderpriority from orders
          where o_orderdate < timestamp '1998-01-01'
          union all select o_orderkey, o_custkey, o_totalprice, null from orders
          where o_orderdate >= timestamp '1998-01-01'""")
def schema_union(spark, sf):
    """Rows written before and after a schema change: one column dropped, one added, one widened."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    change = F.lit("1998-01-01").cast("timestamp_ntz")
    old = orders.where(F.col("o_orderdate") < change).selectExpr(
        "o_orderkey", "cast(o_custkey as int) o_custkey", "o_orderpriority")
    new = orders.where(F.col("o_orderdate") >= change).select("o_orderkey", "o_custkey", "o_totalprice")
    return relations.union_schema([old, new])
