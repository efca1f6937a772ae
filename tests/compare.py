"""Row comparison of a Spark result with the check database, order aside."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def multiset(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(con, sql: str, df) -> list[str]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = multiset(names, result.fetchall())
    found = multiset(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} for {sorted(names)}")
    same = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
            "DATE": "date", "TIMESTAMP": "timestamp_ntz"}
    for name, kind in df.dtypes:
        if name in types and same.get(types[name]) != kind:
            problems.append(f"type of {name}: {kind} for {types[name]}")
    if expected != found:
        more, less = found - expected, expected - found
        problems.append(f"{sum(more.values())} rows too many {list(more)[:2]}, "
                        f"{sum(less.values())} missing {list(less)[:2]}")
    return problems
