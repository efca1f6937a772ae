"""Change feeds derived from the whole of the given tables, as SQL text.

The same text runs in Spark (``{table}`` is a DataFrame) and in the check database (``{table}``
is its name). Positions follow the calendar: a day is worth ``DAY`` bytes of log, and within it
the key makes the position unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

DAY = 1 << 44
SESSION = 10**15  # transaction numbers of long sessions start at multiples of this
TRUNCATE_LSN = 8005


def day_number(column: str) -> str:
    """A number that grows with the date."""
    return (f"cast((year({column}) - 1990) * 372 + month({column}) * 31 + day({column}) as bigint)")


D = day_number("o_orderdate")

# Orders: one load transaction per day; status changes and deletes in one long session per
# customer, open for one market segment and rolled back for customers in debt; a repricing
# transaction per day. Urgent orders change in a sub-transaction that is rolled back.
ORDERS_FEED = f"""
o as (
  select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, {D} d,
         case when c_mktsegment = 'MACHINERY' then 'open'
              when c_acctbal < 0 then 'abort' else 'commit' end fate
  from {{orders}} join {{customer}} on o_custkey = c_custkey),
feed as (
  select cast(1 as bigint) relation_id, o_orderkey k, d * {DAY} + o_orderkey * 16 lsn, 0 seq,
         d xid, d sub_xid, 'insert' kind, o_orderstatus st, 't' st_f, o_totalprice tp, 't' tp_f,
         o_orderpriority pr, 't' pr_f, 'commit' fate, 'commit' sub_fate
  from o
  union all
  select cast(1 as bigint), o_orderkey, (d + 40) * {DAY} + o_orderkey * 16 + 1, 0,
         {SESSION} + o_custkey, {2 * SESSION} + o_orderkey, 'update', 'U', 't',
         o_totalprice + 1, 't', cast(null as varchar(20)), 'u', fate,
         case when o_orderpriority = '1-URGENT' then 'abort' else 'commit' end
  from o where o_orderstatus = 'F'
  union all
  select cast(1 as bigint), o_orderkey, (d + 80) * {DAY} + o_orderkey * 16 + 2, 0,
         {3 * SESSION} + d, {3 * SESSION} + d, 'update', cast(null as varchar(20)), 'u',
         cast(null as double), 'n', 'X', 't', 'commit', 'commit'
  from o where o_orderstatus <> 'O'
  union all
  select cast(1 as bigint), o_orderkey, (d + 120) * {DAY} + o_orderkey * 16 + 3, 0,
         {4 * SESSION} + o_custkey, {4 * SESSION} + o_custkey, 'delete',
         cast(null as varchar(20)), 'n', cast(null as double), 'n', cast(null as varchar(20)), 'n',
         fate, 'commit'
  from o where o_orderpriority = '5-LOW')"""

MARKERS = """
markers as (
  select xid, cast(null as bigint) sub_xid, case max(fate) when 'abort' then 'stream_abort'
         else 'commit' end kind, max(lsn) + 8 lsn
  from feed where fate <> 'open' group by xid
  union all
  select xid, sub_xid, 'stream_abort', max(lsn) + 9 from feed where sub_fate = 'abort'
  group by xid, sub_xid)"""

# The same by definition, for the check database: what is visible, and where.
COMMITTED = """
ended as (select xid, kind, max(lsn) commit_lsn from markers where sub_xid is null group by xid, kind),
committed as (
  select feed.*, ended.commit_lsn from feed join ended on feed.xid = ended.xid
  where ended.kind = 'commit' and sub_fate <> 'abort')"""

# Customers: the initial load, one balance change per order in the order's daily transaction,
# a key change for one segment, and a truncate in the middle of the load.
CUSTOMER_FEED = f"""
feed as (
  select cast(2 as bigint) relation_id, c_custkey k, cast(null as bigint) old_k,
         c_custkey * 16 lsn, 0 seq, {5 * SESSION} + c_custkey xid, 'insert' kind,
         c_name nm, 't' nm_f, c_acctbal bal, c_mktsegment seg, 't' seg_f
  from {{customer}}
  union all
  select cast(2 as bigint), o_custkey, cast(null as bigint), {D} * {DAY} + o_orderkey * 16 + 5, 0,
         {D}, 'update', cast(null as varchar(20)), 'u', o_totalprice, cast(null as varchar(20)), 'u'
  from {{orders}}
  union all
  select cast(2 as bigint), c_custkey + {SESSION}, c_custkey, cast(5500 as bigint) * {DAY} + c_custkey * 16, 0,
         {6 * SESSION} + c_custkey, 'update', c_name, 't', c_acctbal, 'MOVED', 't'
  from {{customer}} where c_mktsegment = 'BUILDING'
  union all
  select cast(2 as bigint), cast(null as bigint), cast(null as bigint), cast({TRUNCATE_LSN} as bigint), 0,
         cast({7 * SESSION} as bigint), 'truncate', cast(null as varchar(20)), 'n', cast(null as double),
         cast(null as varchar(20)), 'n'),
markers as (
  select xid, cast(null as bigint) sub_xid, 'commit' kind, max(lsn) + 8 lsn from feed group by xid),
committed as (
  select feed.*, m.lsn commit_lsn from feed join markers m on feed.xid = m.xid)"""

# Rows that move: every customer changes its key three times. The name comes with the first row only
# (and with an update at the second key for each third customer), the segment with the first move.
# Each fifth customer does all of it in one transaction; the first key of each seventh of the others
# is used again by a new row.
GAP = 1 << 40


def moved_row(step: int, key: str, old: str, kind: str, name: str, balance: str, segment: str, more: str = "",
              where: str = "true", chain: str = "c_custkey") -> str:
    name, name_f = (f"cast({name} as varchar(40))", "t") if name else ("cast(null as varchar(40))", "u")
    segment, segment_f = (f"cast({segment} as varchar(20))", "t") if segment else ("cast(null as varchar(20))", "u")
    return f"""select cast(3 as bigint) relation_id, {chain} ch, {key} k, cast({old} as bigint) old_k,
        cast({step} as bigint) * {GAP} + c_custkey * 64 {more} lsn, 0 seq,
        case when {chain} >= 0 and c_custkey % 5 = 0 then {9 * SESSION} else {step * SESSION} end + c_custkey * 8 + {len(more)} xid,
        '{kind}' kind, {name} nm, '{name_f}' nm_f, {balance} bal, {segment} seg, '{segment_f}' seg_f
        from {{customer}} where {where}"""


MOVES_FEED = "feed as (" + " union all ".join([
    moved_row(0, "c_custkey", "null", "insert", "c_name", "c_acctbal", "c_mktsegment"),
    moved_row(1, f"c_custkey + {SESSION}", "c_custkey", "update", "", "c_acctbal + 1", "'first'"),
    moved_row(1, f"c_custkey + {SESSION}", "null", "update", "'renamed'", "c_acctbal + 2", "", "+ 16",
              "c_custkey % 3 = 0 and c_custkey % 5 <> 0"),
    moved_row(2, f"c_custkey + {2 * SESSION}", f"c_custkey + {SESSION}", "update", "", "c_acctbal + 3", ""),
    moved_row(2, "c_custkey", "null", "insert", "'again'", "c_acctbal + 4", "'reused'", "+ 32",
              "c_custkey % 7 = 0 and c_custkey % 5 <> 0", "-c_custkey"),
    moved_row(3, f"c_custkey + {3 * SESSION}", f"c_custkey + {2 * SESSION}", "update", "", "c_acctbal + 5", ""),
]) + """),
markers as (
  select xid, cast(null as bigint) sub_xid, 'commit' kind, max(lsn) + 8 lsn from feed group by xid),
committed as (
  select feed.*, m.lsn commit_lsn from feed join markers m on feed.xid = m.xid)"""

# By definition: a row keeps what it had, whatever its key was.
MOVES_STATE = """
last as (select * from (select ch, k, bal, row_number() over (
  partition by ch order by commit_lsn desc, lsn desc) n from committed) x where n = 1),
a as (select * from (select ch, nm, row_number() over (
  partition by ch order by commit_lsn desc, lsn desc) n from committed where nm_f <> 'u') x where n = 1),
b as (select * from (select ch, seg, row_number() over (
  partition by ch order by commit_lsn desc, lsn desc) n from committed where seg_f <> 'u') x where n = 1),
state as (select last.k, a.nm, last.bal, b.seg from last left join a on last.ch = a.ch left join b on last.ch = b.ch)"""

FILE_BYTES = "cast(l_quantity * 1000 as bigint)"

# Data files of a table per order: each order line is one file, added in the snapshot of its
# line number; returned lines are removed again seven snapshots later.
FILES = f"""
lines as (
  select l_orderkey, l_linenumber, max(l_returnflag) flag, cast(sum(l_quantity) as bigint) rows_in,
         cast(sum(l_quantity) * 1000 as bigint) bytes_in
  from {{lineitem}} group by l_orderkey, l_linenumber),
files as (
  select concat('t', cast(l_orderkey as varchar(20))) table_name, cast(l_linenumber as bigint) snapshot_id,
         concat('t', cast(l_orderkey as varchar(20)), '/f', cast(l_linenumber as varchar(20))) path,
         1 status, rows_in record_count, bytes_in bytes from lines
  union all
  select concat('t', cast(l_orderkey as varchar(20))), cast(l_linenumber + 7 as bigint),
         concat('t', cast(l_orderkey as varchar(20)), '/f', cast(l_linenumber as varchar(20))),
         3, rows_in, bytes_in from lines where flag = 'R')"""

# A directory per supplier and ship year with a file per order line.
LISTING = """
listing as (
  select concat('s', cast(l_suppkey as varchar(20)), '/y', cast(year(l_shipdate) as varchar(20))) dir,
         concat('s', cast(l_suppkey as varchar(20)), '/y', cast(year(l_shipdate) as varchar(20)), '/o',
                cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-',
                cast(l_partkey as varchar(20)), '.parquet') path,
         cast(sum(l_quantity) * 1000 as bigint) length
  from {lineitem} group by l_suppkey, year(l_shipdate), l_orderkey, l_linenumber, l_partkey)"""

# Catalog rows: a table per order, its lines are columns, the flags choose the type.
CATALOG = """
lines as (
  select l_orderkey, l_linenumber, max(l_returnflag) flag, max(l_linestatus) st
  from {lineitem} group by l_orderkey, l_linenumber),
columns as (
  select 'public' table_schema, concat('t', cast(l_orderkey as varchar(20))) table_name,
         concat('c', cast(l_linenumber as varchar(20))) column_name, l_linenumber ordinal_position,
         case st when 'O' then 'YES' else 'NO' end is_nullable, 'pg_catalog' udt_schema,
         case flag when 'A' then 'int4' when 'N' then 'text' else 'float8' end udt_name
  from lines),
types as (
  select 'pg_catalog' type_namespace, 'int4' type_name, cast(23 as bigint) type_oid
  union all select 'pg_catalog', 'text', cast(25 as bigint)
  union all select 'pg_catalog', 'float8', cast(701 as bigint)
  union all select 'other', 'text', cast(99999 as bigint))"""

# One relation described anew for every day with orders.
DAILY_RELATION = f"""
changes as (
  select cast(1 as bigint) relation_id, {D} * {DAY} + o_orderkey * 16 lsn, 0 seq, 'insert' kind, o_orderkey k from {{orders}}),
messages as (
  select cast(1 as bigint) relation_id, {D} * {DAY} - 1 lsn, 0 seq, 'relation' kind, 'public' ns,
         concat('v', cast({D} as varchar(20))) nm
  from {{orders}} group by {D})"""

# Relation messages: nations are relations, described again in every month with orders. The
# shape changes with the quarter, so some messages repeat the shape before them.
MONTH = "(year(o_orderdate) * 12 + month(o_orderdate))"
RELATIONS = f"""
changes as (
  select cast(c_nationkey as bigint) relation_id, {D} * {DAY} + o_orderkey * 16 lsn, 0 seq, 'insert' kind,
         o_orderkey k
  from {{orders}} join {{customer}} on o_custkey = c_custkey),
messages as (
  select cast(c_nationkey as bigint) relation_id, min({D}) * {DAY} - 1 lsn, 0 seq, 'relation' kind,
         n_name ns, concat('v', cast(cast(floor(({MONTH} - 1) / 3.0) as bigint) as varchar(20))) nm
  from {{orders}} join {{customer}} on o_custkey = c_custkey
       join {{nation}} on c_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey
  where r_name <> 'AFRICA'
  group by c_nationkey, n_name, {MONTH})"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}


def run(spark: SparkSession, sf_dir: str, with_text: str, select: str) -> DataFrame:
    """A query over the derived rows, in Spark."""
    text = f"with {with_text} {select}"
    used = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in TABLES if "{" + n + "}" in text}
    return spark.sql(text, **used)


def check(with_text: str, select: str) -> str:
    """The same for the check database, where the tables are views."""
    text = f"with {with_text} {select}"
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text


def orders_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order changes and transaction markers as one feed."""
    rows = run(spark, sf_dir, ORDERS_FEED, "select * from feed").drop("fate", "sub_fate")
    ends = run(spark, sf_dir, ORDERS_FEED + "," + MARKERS, "select *, 1 seq from markers")
    return rows.unionByName(ends, allowMissingColumns=True)


def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, CUSTOMER_FEED, "select *, xid sub_xid from feed")
    ends = run(spark, sf_dir, CUSTOMER_FEED, "select *, 1 seq from markers")
    return rows.unionByName(ends, allowMissingColumns=True)


def moves_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, MOVES_FEED, "select *, xid sub_xid from feed")
    ends = run(spark, sf_dir, MOVES_FEED, "select *, 1 seq from markers")
    return rows.unionByName(ends, allowMissingColumns=True)
