"""Timings of the headline queries; prints one JSON line.

The change feed is derived from the tables and stored first (``feed_write``); the feed queries
then read it as they would read a landed feed. The last three entries repeat the published
thresholds: 100 counts (5 s), 50 three-way joins (10 s), 10 concurrent counts (3 s).
"""

from __future__ import annotations

import json
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from changelake.operators import compaction, relational, state, transactions  # noqa: E402
from changelake.plans import change_queries, feeds, stream_queries, table_queries  # noqa: E402
from changelake.session import build_session, scratch_path  # noqa: E402
from changelake.sources import inventory  # noqa: E402
from changelake.sources.envelope import read_changes  # noqa: E402
from changelake.streaming.mirror import Mirror  # noqa: E402
from changelake.streaming.table import MirroredTable  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]", "bench",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, work):
        start = time.time()
        work()
        times[name] = round(time.time() - start, 3)

    decoded, raw = scratch_path(spark, "decoded"), scratch_path(spark, "raw")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    run(orders)
    timed("feed_write", lambda: feeds.orders_changes(spark, SF).repartition(int(CPUS)).write.parquet(decoded))
    stream_queries.envelopes(spark, SF).repartition(int(CPUS)).write.parquet(raw)
    feed = spark.read.parquet(decoded)

    def current():
        return state.current_state(transactions.committed(feed), ["k"], change_queries.COLUMNS,
                                   change_queries.COLUMNS)

    timed("current_state", lambda: run(current()))
    timed("state_group_avg", lambda: run(spark.sql(change_queries.BY_STATUS, state=current())))
    timed("history", lambda: run(state.history(transactions.committed(feed), ["k"])))
    timed("pending_rows", lambda: run(transactions.pending(feed)))

    root = scratch_path(spark, "mirror")
    mirror = Mirror(spark, root, [MirroredTable(spark, root, "public", "orders", buckets=int(CPUS))])
    messages, cut = read_changes(spark, raw), stream_queries.CUTS[1]
    timed("mirror_first_batch", lambda: mirror.apply_batch(messages.where(F.col("lsn") < cut), 0))
    timed("mirror_next_batch", lambda: mirror.apply_batch(messages.where(F.col("lsn") >= cut), 1))
    timed("mirror_read", lambda: run(mirror.read("public.orders")))

    small, merged = scratch_path(spark, "small"), scratch_path(spark, "merged")
    spark.read.parquet(f"{SF}/lineitem.parquet").repartition(64).write.parquet(small)
    timed("compaction_lineitem", lambda: compaction.rewrite(
        spark, compaction.plan_by_bytes(inventory.file_inventory(spark, small)), merged))

    for name in ("typed_decode_types", "relation_asof", "column_metrics", "compaction_plan_count",
                 "snapshot_summary", "duration_histogram", "join_three", "group_count_avg"):
        query = getattr(change_queries, name, None) or getattr(table_queries, name)
        timed(name, lambda: run(query(spark, SF)))

    names = ("region", "nation", "supplier", "orders")
    relational.register({n: spark.read.parquet(f"{SF}/{n}.parquet") for n in names}, keep_small=True)

    def count():
        return relational.query(spark, "select count(*) from orders").collect()

    def filtered(key):
        return relational.query(
            spark, "select count(*) from orders where o_orderkey = :k", {"k": key}).collect()

    def join():
        return relational.query(spark, """select s_name, n_name, r_name from supplier
            join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
            where r_name = 'ASIA' order by s_acctbal desc""").collect()

    count(), join()
    timed("count_100", lambda: [count() for _ in range(100)])
    timed("join_50", lambda: [join() for _ in range(50)])
    with ThreadPoolExecutor(10) as pool:
        timed("concurrent_counts_10", lambda: list(pool.map(filtered, range(10))))

    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(SF.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
