"""Scans by partition, and which partitions there are."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillspark.fragment import frag
from quillspark.literals import YearMonth
from quillspark.operators.scan import restrict, scan_partitions, scan_tables
from quillspark.partition import Day, Hour, IntRange, Month, Sharded, Start
from quillspark.queries.base import Registry, events_by_day, read, total, view
from quillspark.sources.partitions import distinct_partitions, row_counts

R = Registry()
_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
_RANGE = IntRange("c_custkey", 0, 4000, 10)


@R.add(f"SELECT {_ORDERS} FROM orders")
def scan_whole_table(spark, sf):
    orders = view(read(spark, sf, "orders"), "quill_orders")
    return frag(f"SELECT {_ORDERS} FROM {{t}}", t=orders.whole_table).run(spark)


@R.add(f"SELECT {_ORDERS} FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-01-02'")
def partition_date_single(spark, sf):
    orders = view(read(spark, sf, "orders"), "quill_orders", Day("o_orderdate", raw=True))
    return frag(f"SELECT {_ORDERS} FROM {{p}}", p=orders.partition(dt.date(1995, 1, 2))).run(spark)


@R.add(f"SELECT {_ORDERS} FROM orders WHERE CAST(o_orderdate AS DATE) IN (DATE '1995-01-02', DATE '1996-03-04', DATE '1998-07-20')")
def partition_date_multi(spark, sf):
    orders = view(read(spark, sf, "orders"), "quill_orders", Day("o_orderdate", raw=True))
    days = [dt.date(1995, 1, 2), dt.date(1996, 3, 4), dt.date(1998, 7, 20), dt.date(1995, 1, 2)]
    return frag(f"SELECT {_ORDERS} FROM {{ps}}", ps=[orders.partition(d) for d in days]).run(spark)


@R.add("SELECT event_id, user_id, event_type FROM events WHERE date_trunc('hour', ts) = TIMESTAMP '2024-01-03 05:00:00'")
def partition_hour_single(spark, sf):
    table = view(read(spark, sf, "events"), "quill_events_all", Hour("ts", raw=True))
    return frag("SELECT event_id, user_id, event_type FROM {p}", p=table.partition(dt.datetime(2024, 1, 3, 5))).run(spark)


@R.add("SELECT event_id, user_id, event_type FROM events WHERE date_trunc('hour', ts) = TIMESTAMP '2024-01-03 05:00:00'")
def partition_hour_bucketed(spark, sf):
    events = read(spark, sf, "events")
    return restrict(events, Hour("ts"), dt.datetime(2024, 1, 3, 5), bucket=True).select("event_id", "user_id", "event_type")


@R.add(f"SELECT {_ORDERS} FROM orders WHERE date_trunc('month', o_orderdate) = DATE '1995-02-01'")
def partition_month_single(spark, sf):
    table = view(read(spark, sf, "orders"), "quill_orders", Month("o_orderdate", raw=True))
    return frag(f"SELECT {_ORDERS} FROM {{p}}", p=table.partition(YearMonth(1995, 2))).run(spark)


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 40 AND 49")
def partition_range_single(spark, sf):
    table = view(read(spark, sf, "customer"), "quill_customer", _RANGE)
    return frag("SELECT c_custkey, c_name FROM {p}", p=table.partition(42)).run(spark)


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 40 AND 49 OR c_custkey BETWEEN 100 AND 109")
def partition_range_multi(spark, sf):
    table = view(read(spark, sf, "customer"), "quill_customer", _RANGE)
    return scan_partitions(spark, [table.partition(v) for v in (42, 105)]).select("c_custkey", "c_name")


@R.add("SELECT CASE WHEN c_custkey BETWEEN 0 AND 4000 THEN c_custkey // 10 * 10 ELSE 0 END AS bucket, count(*) AS n FROM customer GROUP BY 1")
def partition_range_bucket(spark, sf):
    return read(spark, sf, "customer").groupBy(_RANGE.bucket(F.col("c_custkey")).alias("bucket")).agg(F.count("*").alias("n"))


@R.add("""SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-01-02'
    UNION ALL SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-03'""")
def partition_multi_table_union(spark, sf):
    a = view(read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), "o_orderdate"), "quill_union_a", Day("o_orderdate", raw=True))
    b = view(read(spark, sf, "events").select(F.col("event_id").alias("k"), F.col("event_type").alias("v"), "ts"), "quill_union_b", Day("ts", raw=True))
    return frag("SELECT k, v FROM {ps}", ps=[a.partition(dt.date(1995, 1, 2)), b.partition(dt.date(2024, 1, 3))]).run(spark)


@R.add("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def multi_table_union(spark, sf):
    a = view(read(spark, sf, "nation").select(F.col("n_name").alias("name")), "quill_names_a")
    b = view(read(spark, sf, "region").select(F.col("r_name").alias("name")), "quill_names_b")
    return scan_tables(spark, [a, b])


@R.add("""SELECT event_id, event_type, strftime(ts, '%Y%m%d') AS suffix FROM events
    WHERE CAST(ts AS DATE) IN (DATE '2024-01-02', DATE '2024-01-05', DATE '2024-01-20')""")
def shard_wildcard_union(spark, sf):
    events = events_by_day(spark, sf)
    days = [dt.date(2024, 1, 2), dt.date(2024, 1, 5), dt.date(2024, 1, 20)]
    for d in days:
        view(events.where(F.col("d") == F.lit(d)).drop("d"), f"quill_events_{d:%Y%m%d}")
    table = view(events.limit(0), "quill_events", Sharded())
    return scan_partitions(spark, [table.partition(d) for d in days], suffix="suffix").select("event_id", "event_type", "suffix")


@R.add("SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def partitions_from_data(spark, sf):
    return distinct_partitions(events_by_day(spark, sf), Day("d"), Start(dt.date(2024, 1, 10)))


@R.add("SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1")
def partition_counts_date(spark, sf):
    return row_counts(events_by_day(spark, sf), Day("d"))


@R.add("SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1")
def partition_counts_hour(spark, sf):
    events = read(spark, sf, "events").withColumn("h", Hour("h").bucket(F.col("ts")))
    return row_counts(events, Hour("h"), Start(dt.date(2024, 1, 20)).for_scheme(Hour("h")))


@R.add("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-02-01' GROUP BY 1")
def partition_counts_month(spark, sf):
    orders = read(spark, sf, "orders").withColumn("m", Month("m").bucket(F.col("o_orderdate")))
    return row_counts(orders, Month("m"), Start(dt.date(1996, 2, 17)))


@R.add("SELECT CAST(c_custkey // 10 * 10 AS BIGINT) AS c_custkey, count(*) AS n FROM customer WHERE c_custkey BETWEEN 100 AND 4000 GROUP BY 1")
def partition_counts_range(spark, sf):
    bucketed = read(spark, sf, "customer").where("c_custkey <= 4000").withColumn("c_custkey", _RANGE.bucket(F.col("c_custkey")))
    return row_counts(bucketed, _RANGE, Start(100))


@R.add(f"SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, {total('o_totalprice')} AS amount FROM orders WHERE o_orderdate >= DATE '2000-05-01' GROUP BY 1")
def partition_list_start_bound(spark, sf):
    orders = read(spark, sf, "orders").withColumn("m", Month("m").bucket(F.col("o_orderdate")))
    start = Start(dt.datetime(2000, 5, 9, 12)).for_scheme(Month("m"))
    return orders.where(start.predicate(Month("m"))).groupBy("m").agg(F.expr(total("o_totalprice")).alias("amount"))


QUERIES, ORACLES = R.queries, R.oracles
