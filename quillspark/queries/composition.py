"""Fragments, functions, views and projections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillspark.fragment import conditions, frag, joined
from quillspark.functions.routines import Param, Tvf, Udf
from quillspark.ids import Ident, TableId
from quillspark.literals import Limit
from quillspark.operators.projection import Drop, Flatten, Keep, Rename, project
from quillspark.partition import Day
from quillspark.queries.base import Registry, events_by_day, orders_by_day, read, view
from quillspark.tables import View
from quillspark.types import Field, Mode, Schema, Type, TypeOf

R = Registry()
_LONG, _DOUBLE, _TEXT, _DATE = (TypeOf(Mode.NULLABLE, t) for t in (Type.INT64, Type.FLOAT64, Type.STRING, Type.DATE))


@R.add("""SELECT e.user_id, c.c_name, count(*) AS n, string_agg(e.event_type || ':' || CAST(e.event_id AS VARCHAR), ',' ORDER BY e.event_id) AS activity
    FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE CAST(e.ts AS DATE) = DATE '2024-01-03' GROUP BY 1, 2""")
def daily_activity_array_agg(spark, sf):
    """One day's activity of each user, as an array of structs."""
    events = view(events_by_day(spark, sf), "quill_events_day", Day("d"))
    users = view(read(spark, sf, "customer"), "quill_customer")
    query = frag(
        """SELECT e.user_id, c.c_name, count(*) AS n,
               concat_ws(',', transform(array_sort(array_agg(struct(e.event_id, e.event_type))), x -> concat(x.event_type, ':', x.event_id))) AS activity
           FROM {day} e JOIN {users} c ON e.user_id = c.c_custkey GROUP BY 1, 2""",
        day=events.partition(dt.date(2024, 1, 3)), users=users,
    )
    return query.run(spark)


def _nested(spark, sf):
    f = Field.struct(
        "foo", Field("keep_me", Type.STRING), Field("drop_me", Type.STRING), Field("rename_me", Type.STRING),
        Field.struct("keep_struct", Field("one", Type.STRING), Field("two", Type.STRING)),
        Field.struct("flatten_struct", Field("one", Type.STRING), Field("two", Type.STRING)),
    )
    pair = lambda a, b: F.struct(F.col(a).alias("one"), F.col(b).alias("two"))
    foo = F.struct(F.col("c_name").alias("keep_me"), F.lit("x").alias("drop_me"), F.col("c_mktsegment").alias("rename_me"), pair("c_name", "c_mktsegment").alias("keep_struct"), pair("c_mktsegment", "c_name").alias("flatten_struct"))
    return read(spark, sf, "customer").select("c_custkey", foo.alias("foo")), f


@R.add("""SELECT c_custkey, c_name AS keep_me, c_mktsegment AS renamed, c_name AS kept_one, c_mktsegment AS kept_two,
    c_mktsegment AS flat_one, c_name AS flat_two, 5 AS n_fields FROM customer""")
def projection_keep_drop_rename_flatten(spark, sf):
    df, f = _nested(spark, sf)
    do = {"drop_me": Drop(), "rename_me": Rename("renamed"), "flatten_struct": Flatten("flat")}
    column, out = project(f, lambda x: do.get(x.name, Keep()))
    got = df.select("c_custkey", column)
    return got.select("c_custkey", "foo.keep_me", "foo.renamed", F.col("foo.keep_struct.one").alias("kept_one"), F.col("foo.keep_struct.two").alias("kept_two"), F.col("foo.flatOne").alias("flat_one"), F.col("foo.flatTwo").alias("flat_two"), F.lit(len(out.fields)).alias("n_fields"))


def _lines(spark, sf):
    line = F.struct(F.col("l_linenumber").cast("long").alias("number"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"))
    f = Field.struct("o", Field.repeated_struct("lines", Field("number", Type.INT64), Field("flag", Type.STRING), Field("part", Type.INT64)))
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return lines.select("l_orderkey", F.struct("lines").alias("o")), f


@R.add("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS number, l_partkey AS part_key FROM lineitem")
def projection_array_rewrite(spark, sf):
    df, f = _lines(spark, sf)
    do = {"flag": Drop(), "part": Rename("part_key")}
    column, _ = project(f, lambda x: do.get(x.name, Keep()))
    return df.select("l_orderkey", F.explode(column.getField("lines")).alias("x")).select("l_orderkey", "x.number", "x.part_key")


@R.add("SELECT l_orderkey, l_returnflag AS flag FROM lineitem")
def projection_array_singleton(spark, sf):
    df, f = _lines(spark, sf)
    column, _ = project(f, lambda x: Drop() if x.name in ("number", "part") else Keep())
    return df.select("l_orderkey", F.explode(column.getField("lines")).alias("flag"))


@R.add("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE (c_acctbal > 100) AND (c_mktsegment IN ('BUILDING', 'it''s'))")
def column_list_and_conditions(spark, sf):
    t = view(read(spark, sf, "customer"), "quill_customer")
    where = conditions(frag("c_acctbal > {v}", v=100), None, frag("c_mktsegment IN ({v})", v=joined(["BUILDING", "it's"])))
    return frag("SELECT {cols} FROM {t} WHERE {where} {limit}", cols=[Ident("c_custkey"), Ident("c_name"), Ident("c_acctbal")], t=t, where=where, limit=Limit()).run(spark)


@R.add("SELECT c_custkey, CAST(c_custkey AS DOUBLE) * 2 / 2 AS halved FROM customer")
def udf_temp_nested(spark, sf):
    double = Udf("quill_double", (Param("x", _LONG),), frag("x * 2"), _LONG)
    half = Udf("quill_half", (Param("y", _LONG),), frag("y / 2"), _DOUBLE)
    t = view(read(spark, sf, "customer"), "quill_customer")
    return frag("SELECT c_custkey, {x} AS halved FROM {t}", x=half(double(frag("c_custkey"))), t=t).run(spark)


@R.add("SELECT c_custkey, c_name || ' ' || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment || ' ' END || CAST(c_nationkey AS VARCHAR) AS full_name FROM customer")
def udf_struct_full_name(spark, sf):
    of = TypeOf(Mode.NULLABLE, Type.STRUCT, (("first", _TEXT), ("middle", _TEXT), ("last", _TEXT)))
    full = Udf("quill_full_name", (Param("n", of),), frag("n.first || ' ' || coalesce(n.middle || ' ', '') || n.last"), _TEXT)
    t = view(read(spark, sf, "customer"), "quill_customer")
    name = frag("named_struct('first', c_name, 'middle', nullif(c_mktsegment, {b}), 'last', string(c_nationkey))", b="BUILDING")
    return frag("SELECT c_custkey, {x} AS full_name FROM {t}", x=full(name), t=t).run(spark)


@R.add("SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-01-02' AND o_totalprice > 1000")
def tvf_parameterised(spark, sf):
    view(orders_by_day(spark, sf), "quill_orders_day")
    f = Tvf("quill_orders_of", (Param("day", _DATE), Param("least", _LONG)), frag("SELECT o_orderkey, o_totalprice FROM quill_orders_day WHERE d = day AND o_totalprice > least"), Schema.of(Field("o_orderkey", Type.INT64), Field("o_totalprice", Type.FLOAT64)))
    return frag("SELECT * FROM {f}", f=f(dt.date(1995, 1, 2), 1000)).run(spark)


@R.add("""SELECT e.event_id, e.user_id, c.c_name || coalesce(' ' || nullif(c.c_mktsegment, 'BUILDING'), '') AS full_name, e.event_type
    FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE CAST(e.ts AS DATE) = DATE '2024-01-05'""")
def view_normalised_activity(spark, sf):
    events = view(events_by_day(spark, sf), "quill_events_day", Day("d"))
    users = view(read(spark, sf, "customer"), "quill_customer")
    body = frag(
        """SELECT e.d, e.event_id, e.user_id, c.c_name || coalesce(' ' || nullif(c.c_mktsegment, 'BUILDING'), '') AS full_name, e.event_type
           FROM {e} e JOIN {u} c ON e.user_id = c.c_custkey WHERE c.c_name IS NOT NULL""",
        e=events.unpartitioned, u=users,
    )
    v = View(TableId.local("quill_activity"), Day("d"), query=body)
    body.run(spark).createOrReplaceTempView("quill_activity")
    return frag("SELECT event_id, user_id, full_name, event_type FROM {p}", p=v.partition(dt.date(2024, 1, 5))).run(spark)


@R.add("SELECT x AS n, x * x AS square FROM (SELECT CAST(unnest([1, 2, 3, 5]) AS BIGINT) AS x)")
def array_scan(spark, sf):
    return frag("SELECT n, n * n AS square FROM (SELECT explode({xs}) AS n)", xs=Literal([1, 2, 3, 5]).frag).run(spark)


class Literal:
    """A Python list as an array in SQL."""

    def __init__(self, values: list):
        self.frag = frag("array({v})", v=joined(values))


@R.add("SELECT c_custkey, c_acctbal IS NOT DISTINCT FROM nullif(c_acctbal, 0) AS same FROM customer")
def predicate_null_safe(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").eqNullSafe(F.expr("nullif(c_acctbal, 0D)")).alias("same"))


QUERIES, ORACLES = R.queries, R.oracles
