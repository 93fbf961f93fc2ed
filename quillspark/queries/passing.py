"""SQL that is passed on to Spark as it is: joins, aggregates, windows, sets, JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.fragment import frag
from quillspark.queries.base import Registry, read, total, view

R = Registry()


def _views(spark, sf, *names):
    return {n: view(read(spark, sf, n), f"quill_{n}") for n in names}


def _sql(name: str, oracle: str, *tables: str, spark_sql: str | None = None):
    """A query that is the same text in both dialects."""

    def query(spark, sf):
        return frag((spark_sql or oracle).replace("[[", "{").replace("]]", "}"), **_views(spark, sf, *tables)).run(spark)

    plain = oracle
    for t in tables:
        plain = plain.replace(f"[[{t}]]", t)
    query.__name__ = name
    R.add(plain)(query)


_sql("join_inner", "SELECT n.n_name, r.r_name FROM [[nation]] n JOIN [[region]] r ON n.n_regionkey = r.r_regionkey", "nation", "region")
_sql("join_using_cte", """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM [[orders]] GROUP BY 1), b AS (SELECT c_custkey AS k, c_name AS name FROM [[customer]])
    SELECT k, n, name FROM a JOIN b USING (k)""", "orders", "customer")  # fmt: skip
# rows without a partner on either side: keys are shifted
_ON = "o.o_custkey + 75 = c.c_custkey"
_sql("join_left", f"SELECT c.c_custkey, count(o.o_orderkey) AS n FROM [[customer]] c LEFT JOIN [[orders]] o ON {_ON} GROUP BY 1", "customer", "orders")
_sql("join_right", f"SELECT c.c_custkey, o.o_orderkey FROM [[orders]] o RIGHT JOIN [[customer]] c ON {_ON}", "customer", "orders")
_sql("join_full", f"SELECT c.c_custkey, o.o_orderkey FROM [[customer]] c FULL JOIN [[orders]] o ON {_ON}", "customer", "orders")
_sql("join_semi", f"SELECT c_custkey, c_name FROM [[customer]] c WHERE EXISTS (SELECT 1 FROM [[orders]] o WHERE {_ON})", "customer", "orders")
_sql("join_anti", f"SELECT c_custkey, c_name FROM [[customer]] c WHERE NOT EXISTS (SELECT 1 FROM [[orders]] o WHERE {_ON})", "customer", "orders")
_sql("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM [[region]] a, [[region]] b", "region")
_sql("countif_group_ordinal", "SELECT o_orderstatus, o_orderpriority, CAST(count_if(o_totalprice > 1000) AS BIGINT) AS n, CAST(count_if(o_custkey IS NULL) AS BIGINT) AS missing FROM [[orders]] GROUP BY 1, 2", "orders")
_sql("count_view", "SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM [[orders]] GROUP BY 1", "orders")
_sql("cube", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {total('l_quantity')} AS q FROM [[lineitem]] GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
_sql("rollup", f"SELECT l_returnflag, l_linestatus, {total('l_quantity')} AS q FROM [[lineitem]] GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
_sql("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM [[lineitem]] GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "lineitem")
_sql("window_rank", "SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rk FROM [[orders]]", "orders")
_sql("window_running_count", "SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM [[orders]]", "orders")
_sql("window_running_sum", "SELECT o_custkey, o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS s FROM [[orders]]", "orders")
_sql("window_qualify", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM [[orders]]) x WHERE k = 1", "orders")
_sql("limit_topk", "SELECT o_orderkey, o_totalprice FROM [[orders]] ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "orders")
_sql("set_union_distinct", "SELECT n_nationkey AS k FROM [[nation]] UNION SELECT c_nationkey FROM [[customer]]", "nation", "customer")
_sql("set_intersect", "SELECT n_nationkey + 5 AS k FROM [[nation]] INTERSECT SELECT c_nationkey FROM [[customer]]", "nation", "customer")
_sql("set_except", "SELECT n_nationkey + 5 AS k FROM [[nation]] EXCEPT SELECT c_nationkey FROM [[customer]]", "nation", "customer")
_sql("array_distinct", "SELECT o_custkey, CAST(size(collect_set(o_orderstatus)) AS BIGINT) AS n FROM [[orders]] GROUP BY 1", "orders")
R.oracles["array_distinct"] = "SELECT o_custkey, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n FROM orders GROUP BY 1"


@R.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_props(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@R.add("""WITH RECURSIVE days(d) AS (SELECT DATE '2024-01-01' UNION ALL SELECT CAST(d + INTERVAL 1 DAY AS DATE) FROM days WHERE d < DATE '2024-02-05')
    SELECT d, count(e.event_id) AS n FROM days LEFT JOIN events e ON CAST(e.ts AS DATE) = d GROUP BY d""")
def recursive_cte_calendar(spark, sf):
    e = view(read(spark, sf, "events"), "quill_events_all")
    return frag(
        """WITH RECURSIVE days(d) AS (SELECT DATE'2024-01-01' UNION ALL SELECT date_add(d, 1) FROM days WHERE d < DATE'2024-02-05')
           SELECT d, count(e.event_id) AS n FROM days LEFT JOIN {e} e ON CAST(e.ts AS DATE) = d GROUP BY d""",
        e=e,
    ).run(spark)


@R.add("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, true AS parts_near, true AS suppliers_near FROM lineitem GROUP BY 1")
def approx_distinct(spark, sf):
    """Sketches by group, and whether they are within 8 % of the exact counts."""
    rows = read(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.hll_sketch_estimate(F.hll_sketch_agg("l_suppkey")).alias("b"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers")
    )
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= 0.08 * F.col(y)
    return rows.select("l_returnflag", "parts", "suppliers", near("a", "parts").alias("parts_near"), near("b", "suppliers").alias("suppliers_near"))


@R.add("SELECT l_returnflag, CAST(l_shipdate AS DATE) AS first_day, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def first_per_group(spark, sf):
    """By an aggregate rather than a sort of each group, which may be large."""
    first = F.min(F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("x")
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(first).select("l_returnflag", F.col("x.l_shipdate").cast("date").alias("first_day"), "x.l_orderkey")


@R.add("""SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf):
    rows = read(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.expr(total("l_quantity")).alias("sum_qty"), F.expr(total("l_extendedprice")).alias("sum_price"), F.count("*").alias("n"))


def _window(*by):
    return Window.partitionBy(*by)


@R.add("SELECT user_id, event_id, CAST(date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS BIGINT) AS gap FROM events")
def window_lag(spark, sf):
    before = F.lag("ts").over(_window("user_id").orderBy("ts", "event_id"))
    return read(spark, sf, "events").select("user_id", "event_id", F.timestamp_diff("second", F.date_trunc("second", before), F.date_trunc("second", "ts")).alias("gap"))


QUERIES, ORACLES = R.queries, R.oracles
