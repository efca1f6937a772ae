"""One query per family of SQL that clients may send; Spark has each built in.

The text is the same in both engines. ``{table}`` is replaced by the table.
"""

from __future__ import annotations

from changelake.plans import feeds
from changelake.plans.registry import query
from changelake.session import any_size

TEXTS = {
    "sql_outer_joins": """
        select coalesce(a.k, b.k) k, a.n made, b.n sold from
          (select s_nationkey k, count(*) n from {supplier} where s_acctbal > 5000 group by s_nationkey) a
          full join (select c_nationkey k, count(*) n from {customer} where c_acctbal > 9000 group by c_nationkey) b
          on a.k = b.k""",
    "sql_semi_anti_joins": """
        select c_custkey, 'none' has from {customer} where not exists
          (select 1 from {orders} where o_custkey = c_custkey and o_orderstatus = 'F')
        union all
        select c_custkey, 'some' from {customer} where c_custkey in
          (select o_custkey from {orders} where o_orderpriority = '1-URGENT')""",
    "sql_distinct_aggregates": """
        select o_orderstatus, count(distinct o_custkey) customers, count(distinct o_orderpriority) priorities,
               count(*) filter (where o_totalprice > 100000) large, min(o_orderdate) first_day
        from {orders} group by o_orderstatus""",
    "sql_grouping_sets": """
        select l_returnflag, l_linestatus, count(*) n, cast(sum(cast(l_quantity as bigint)) as bigint) qty
        from {lineitem} group by cube (l_returnflag, l_linestatus)""",
    "sql_windows": """
        select o_orderkey, cast(rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) place,
               lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) previous,
               count(*) over (partition by o_custkey order by o_orderdate, o_orderkey
                              rows between 2 preceding and current row) recent
        from {orders}""",
    "sql_top_orders": """
        select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 10 offset 5""",
    "sql_set_operations": """
        (select c_nationkey k from {customer} intersect select s_nationkey from {supplier})
        union all (select n_nationkey from {nation} except select s_nationkey from {supplier})""",
    "sql_recursive": """
        with recursive walk as (
          select c_custkey k, c_nationkey n, 0 depth from {customer}
          union all select k, cast(floor(n / 5.0) as int), depth + 1 from walk where n >= 5)
        select k, n, depth from walk""",
    "sql_functions": """
        select event_id, upper(substr(event_type, 1, 3)) code, cast(length(props) as bigint) size, cast(year(ts) as bigint) y, cast(month(ts) as bigint) m,
               round(value) whole, abs(value - 100) distance, coalesce(nullif(event_type, 'click'), 'none') other,
               concat_ws('/', event_type, cast(user_id as varchar(20))) tag,
               case when value between 10 and 20 then 'mid' when value < 10 then 'low' else 'high' end band
        from {events}""",
    "sql_subqueries": """
        select o_orderkey, o_totalprice from {orders} o
        where o_totalprice > (select avg(cast(i.o_totalprice as decimal(18, 2))) from {orders} i
                              where i.o_custkey = o.o_custkey)""",
}


def _plain(text: str) -> str:
    for name in feeds.TABLES:
        text = text.replace("{" + name + "}", name)
    return text


def _add(name: str, text: str) -> None:
    @query(_plain(text), name)
    def run(spark, sf):
        if "with recursive" in text:
            any_size(spark)
        used = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in feeds.TABLES if "{" + n + "}" in text}
        return spark.sql(text, **used)


for _name, _text in TEXTS.items():
    _add(_name, _text)


@query("select event_id, cast(json_extract(props, '$.k') as integer) k from events")
def sql_json(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "event_id", "try_variant_get(parse_json(props), '$.k', 'int') k")
