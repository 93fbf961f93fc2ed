"""What the rest of the library gives, held against SQL: metadata, routines, updates, checks, jobs."""

from __future__ import annotations

import datetime as dt
import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from quillspark.client import Client, JobId, Metrics, Retry
from quillspark.fragment import frag
from quillspark.functions.routines import Param, Tvf, Udf
from quillspark.ids import DatasetRef, ProjectId, TableId, TableLabels
from quillspark.literals import YearMonth
from quillspark.partition import Day, Hour, IntRange, Month, Sharded, Start, newest_first
from quillspark.plans import analysis, codegen, conforms, deploy
from quillspark.plans.catalog import Catalog, from_json, routine_from_json, routine_to_json, to_json
from quillspark.queries.base import Registry, days_of, events_by_day, read, view
from quillspark.queries.maintenance import _loaded
from quillspark.queries.writing import _clear, _fresh
from quillspark.sources.extract import Avro, Csv, JsonLines, Parquet, extract
from quillspark.sources.load import Disposition, delete_where, load_json, merge_into, update_where, write
from quillspark.sources.partitions import list_partitions, table_metadata
from quillspark.streaming.fills import log_rows, run_fills
from quillspark.tables import FilledTable, MaterializedView, Table, TableOptions, View
from quillspark.testkit.checks import Check, check_fails, check_fill, check_queries, check_query, check_tvf, check_type, check_udf, check_view, example_row, golden
from quillspark.types import Field, Mode, Schema, Type, TypeOf

R = Registry()
_DS = DatasetRef(ProjectId("quill-tests"), "surface")
_LONG, _TEXT = TypeOf(Mode.NULLABLE, Type.INT64), TypeOf(Mode.NULLABLE, Type.STRING)
_EVENTS = (Field("event_id", Type.INT64), Field("event_type", Type.STRING), Field("d", Type.DATE))


def _pairs(spark, rows, a="name", b="value"):
    return spark.createDataFrame([(str(x), str(y)) for x, y in rows], f"{a} string, {b} string")


def _expected(*rows) -> str:
    return "SELECT name, value FROM (VALUES " + ", ".join("('{}', '{}')".format(*(str(x).replace("'", "''") for x in r)) for r in rows) + ") x (name, value)"


def _error(action) -> str:
    try:
        action()
    except Exception as e:
        return type(e).__name__
    return "none"


def _catalog(spark) -> Catalog:
    catalog = Catalog(spark)
    catalog.create_dataset(_DS)
    return catalog


# partitions and metadata


@R.add("SELECT 'events' AS name, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, true AS has_bytes FROM events")
def table_metadata_whole(spark, sf):
    table = _loaded(spark, sf, "described", key="surface")
    whole = table_metadata(spark, table, with_rows=True)
    return spark.createDataFrame([("events", whole.rows, len(list_partitions(spark, table)), whole.bytes > 0 and whole.created <= whole.modified)], "name string, n long, days long, has_bytes boolean")


@R.add("SELECT 'whole' AS kind, 'all' AS part, count(*) AS n FROM events UNION ALL SELECT 'day', strftime(ts, '%Y%m%d'), count(*) FROM events GROUP BY 2")
def partition_dispatch(spark, sf):
    """One listing for tables of any scheme: with days, and without partitions."""
    day = _loaded(spark, sf, "dispatched", key="surface")
    plain = Table(day.id, schema=day.schema)
    rows = [("day", p.scheme.suffix(p.value), m.rows) for p, m in list_partitions(spark, day, with_rows=True)]
    rows += [("whole", "all", m.rows) for _, m in list_partitions(spark, plain, with_rows=True)]
    return spark.createDataFrame(rows, "kind string, part string, n long")


@R.add("""SELECT DISTINCT 'hour' AS scheme, 'tt$' || strftime(ts, '%Y%m%d%H') AS name, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS value FROM events
    UNION ALL SELECT DISTINCT 'day', 'tt$' || strftime(ts, '%Y%m%d'), strftime(ts, '%Y-%m-%d') FROM events
    UNION ALL SELECT DISTINCT 'month', 'tt$' || strftime(o_orderdate, '%Y%m'), strftime(o_orderdate, '%Y-%m') FROM orders
    UNION ALL SELECT DISTINCT 'shard', 'tt_' || strftime(ts, '%Y%m%d'), strftime(ts, '%Y-%m-%d') FROM events""")
def partition_names(spark, sf):
    """Names of all partitions, and the values parsed back from them."""
    events, orders = read(spark, sf, "events"), read(spark, sf, "orders")
    out = []
    for label, scheme, values, show in (
        ("hour", Hour("ts"), [r[0] for r in events.select(Hour("ts").bucket(F.col("ts"))).distinct().collect()], lambda v: f"{v:%Y-%m-%d %H}"),
        ("day", Day("ts"), days_of(spark, sf), lambda v: f"{v:%Y-%m-%d}"),
        ("month", Month("m"), [YearMonth(r[0].year, r[0].month) for r in orders.select(F.trunc("o_orderdate", "month")).distinct().collect()], lambda v: f"{v.year}-{v.month:02}"),
        ("shard", Sharded(), days_of(spark, sf), lambda v: f"{v:%Y-%m-%d}"),
    ):
        for v in values:
            name = Table(TableId.local("tt"), scheme).partition(v).table_id.table
            out.append((label, name, show(scheme.parse(name))))
    return spark.createDataFrame(out, "scheme string, name string, value string")


@R.add("SELECT CAST(row_number() OVER (ORDER BY d DESC) AS BIGINT) AS place, d FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)")
def partitions_newest_first(spark, sf):
    table = Table(TableId.local("tt"), Day("d"))
    found = newest_first([table.partition(d) for d in days_of(spark, sf)])
    return spark.createDataFrame([(k, p.value) for k, p in enumerate(found, 1)], "place long, d date")


@R.add("SELECT event_id, event_type, CAST(ts AS DATE) AS d FROM events WHERE CAST(ts AS DATE) IN (DATE '2024-01-03', DATE '2024-01-05')")
def partition_catalog_pruned(spark, sf):
    """Two days of a table that is partitioned in the catalog; the plan has partition filters."""
    table = _loaded(spark, sf, "pruned", key="surface")
    return frag("SELECT event_id, event_type, d FROM {ps}", ps=[table.partition(dt.date(2024, 1, k)) for k in (3, 5)]).run(spark)


@R.add("SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1")
def partition_listing_from_start(spark, sf):
    table = _loaded(spark, sf, "bounded", key="surface")
    found = list_partitions(spark, table, Start(dt.datetime(2024, 1, 20, 7)), with_rows=True)
    return spark.createDataFrame([(p.value, m.rows) for p, m in found], "d date, n long")


@R.add("SELECT o_orderkey, o_totalprice FROM orders")
def result_stream(spark, sf):
    """All rows through the streaming reader, as a job."""
    orders = view(read(spark, sf, "orders"), "quill_orders")
    rows = Client(spark).stream(JobId("all_orders"), frag("SELECT o_orderkey, o_totalprice FROM {t}", t=orders))
    return spark.createDataFrame([(r["o_orderkey"], r["o_totalprice"]) for r in log_rows(rows)], "o_orderkey long, o_totalprice double")


# functions


@R.add("SELECT c_custkey, c_custkey + 1 AS next, c_custkey * 2 AS twice FROM customer")
def udf_persistent(spark, sf):
    """A function of the catalog, and one declared elsewhere that is called by its name."""
    _catalog(spark)
    plus = Udf("plus_one", (Param("x", _LONG),), frag("x + 1"), _LONG, _DS)
    Udf("doubled", (Param("x", _LONG),), frag("x * 2"), _LONG, _DS).register(spark)
    plus.register(spark)
    reference = Udf("doubled", (Param("x", _LONG),), None, _LONG, _DS)
    t = view(read(spark, sf, "customer"), "quill_customer")
    return frag("SELECT c_custkey, {a} AS next, {b} AS twice FROM {t}", a=plus(frag("c_custkey")), b=reference(frag("c_custkey")), t=t).run(spark)


@R.add("SELECT c_custkey, c_custkey + 1 AS next FROM customer")
def udf_persistent_as_temporary(spark, sf):
    plus = Udf("plus_one_here", (Param("x", _LONG),), frag("x + 1"), _LONG, _DS).as_temporary()
    return frag("SELECT c_custkey, {a} AS next FROM {t}", a=plus(frag("c_custkey")), t=view(read(spark, sf, "customer"), "quill_customer")).run(spark)


@R.add("SELECT c_custkey, CAST(c_custkey AS VARCHAR) || '/' || CAST(c_custkey AS VARCHAR) AS a, c_name || '/' || c_name AS b FROM customer")
def udf_untyped_parameter(spark, sf):
    """One function for arguments of different types."""
    twice = Udf("quill_twice", (Param("x"),), frag("concat(x, '/', x)"), _TEXT)
    t = view(read(spark, sf, "customer"), "quill_customer")
    return frag("SELECT c_custkey, {a} AS a, {b} AS b FROM {t}", a=twice(frag("c_custkey")), b=twice(frag("c_name")), t=t).run(spark)


@R.add(_expected(("order", "bb cc aa"), ("lineage", "bb cc aa"), ("too few", "TypeError"), ("too many", "TypeError"), ("same text", "True"), ("other text", "False")))
def routine_report(spark, sf):
    """Functions in order of need, calls with wrong counts, equality by text."""
    one = lambda name: Udf(name, (Param("x", _LONG),), frag("x + 1"), _LONG)
    bb, cc = one("bb"), one("cc")
    aa = Udf("aa", (Param("x", _LONG), Param("y", _LONG)), frag("x + y"), _LONG)
    q = frag("SELECT {x} AS v", x=aa(bb(frag("1L")), cc(frag("2L"))))
    rows = [
        ("order", " ".join(u.name for u in q.temporary_functions())), ("lineage", " ".join(u.name for u in q.functions())), ("too few", _error(lambda: aa(1))), ("too many", _error(lambda: bb(1, 2))),
        ("same text", frag("a {x}", x=frag("1")) == frag("a 1")), ("other text", frag("a") == frag("b")),
    ]
    q.run(spark)
    return _pairs(spark, rows)


@R.add("SELECT r_regionkey, r_name LIKE '%A' AS ends, '{\"k\":' || CAST(r_regionkey AS VARCHAR) || '}' AS js, true AS today FROM region")
def functions_passed_on(spark, sf):
    t = view(read(spark, sf, "region"), "quill_region")
    return frag("SELECT r_regionkey, regexp_like(r_name, 'A$') AS ends, to_json(named_struct('k', r_regionkey)) AS js, current_date() >= DATE'2024-01-01' AS today FROM {t}", t=t).run(spark)


# loads, merges, updates


@R.add("SELECT event_id, event_type, CAST(ts AS DATE) AS d FROM events")
def load_json_file(spark, sf):
    """All events by way of compressed JSON lines."""
    table = _fresh(spark, "from_json", Day("d"), *_EVENTS, key="surface")
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quill_surface_json"
    extract(events_by_day(spark, sf).select("event_id", "event_type", "d"), path, JsonLines(), "gzip", mode="overwrite")
    load_json(spark, table, path)
    return table.frame(spark)


@R.add("""SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-04' THEN 'new' ELSE event_type END AS event_type, CAST(ts AS DATE) AS d FROM events""")
def merge_partition_ids(spark, sf):
    """One partition of a table into the same of another."""
    target = _loaded(spark, sf, "merge_target", key="surface")
    source = _fresh(spark, "merge_source", Day("d"), *_EVENTS, key="surface")
    write(events_by_day(spark, sf).select("event_id", F.lit("new").alias("event_type"), "d"), source, Disposition.EMPTY)
    day = dt.date(2024, 1, 4)
    merge_into(source.partition(day), target.partition(day), ["event_id"])
    return target.frame(spark)


@R.add("SELECT event_id, event_type, CAST(ts AS DATE) AS d FROM events WHERE event_type <> 'view' AND CAST(ts AS DATE) <> DATE '2024-01-09'")
def delete_rows(spark, sf):
    table = _loaded(spark, sf, "deleted", key="surface")
    delete_where(table, (F.col("event_type") == "view") | (F.col("d") == F.lit(dt.date(2024, 1, 9))))
    return table.frame(spark)


@R.add("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'seven' ELSE event_type END AS event_type, CAST(ts AS DATE) AS d FROM events")
def update_rows(spark, sf):
    table = _loaded(spark, sf, "updated", key="surface")
    update_where(table, F.col("event_id") % 7 == 0, {"event_type": F.lit("seven")})
    return table.frame(spark)


@R.add(_expected(("types", "SchemaMismatch"), ("names", "SchemaMismatch"), ("repeated key", "DuplicateKeys"), ("null in required", "RequiredNull"), ("other day", "QuillError"), ("not empty", "QuillError"), ("unknown column", "SchemaMismatch")))
def write_errors(spark, sf):
    """What a write refuses, on tables that hold all events."""
    from quillspark.operators.merge import upsert

    table = _loaded(spark, sf, "refusing", key="surface")
    rows, strict = table.frame(spark), _fresh(spark, "strict", Day("d"), Field("event_id", Type.INT64, Mode.REQUIRED), Field("d", Type.DATE), key="surface")
    day = table.partition(dt.date(2024, 1, 4))
    return _pairs(spark, [
        ("types", _error(lambda: upsert(rows.withColumn("event_id", F.col("event_id").cast("string")), rows, ["event_id"]))), ("names", _error(lambda: upsert(rows.withColumnRenamed("event_type", "t"), rows, ["event_id"]))),
        ("repeated key", _error(lambda: merge_into(rows.union(rows), table, ["event_id"]))), ("null in required", _error(lambda: write(rows.select(F.nullif("event_id", "event_id").alias("event_id"), "d"), strict, Disposition.APPEND))),
        ("other day", _error(lambda: write(events_by_day(spark, sf).select("event_id", "event_type", "d"), day, Disposition.TRUNCATE))), ("not empty", _error(lambda: write(rows, table, Disposition.EMPTY))), ("unknown column", _error(lambda: write(rows.withColumn("x", F.lit(1)), table, Disposition.APPEND))),
    ])


@R.add(_expected(*((f, " ".join(c)) for f, c in (("csv", ("none", "gzip")), ("json", ("none", "gzip")), ("parquet", ("none", "gzip", "zstd"))))))
def extract_combinations(spark, sf):
    """Which compressions each format takes, with all of region; every other is refused."""
    df, where = read(spark, sf, "region"), spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    out = []
    for fmt in (Csv(), JsonLines(), Parquet()):
        good = [c for c in ("none", "gzip", "snappy", "deflate", "zstd") if _error(lambda c=c, fmt=fmt: extract(df, f"{where}/quill_combinations_{fmt.name}_{c}", fmt, c, mode="overwrite")) == "none"]
        out.append((fmt.name, " ".join(good)))
    assert set(Avro().compressions) == {"none", "gzip", "snappy", "deflate"}
    return _pairs(spark, out)


@R.add("SELECT event_type, count(*) AS n, CAST(ts AS DATE) AS d FROM events GROUP BY 1, 3")
def fills_with_progress(spark, sf):
    """Days filled one after the other, each told."""
    events = view(events_by_day(spark, sf), "quill_events_day", Day("d"))
    table = _fresh(spark, "filled_days", Day("d"), Field("event_type", Type.STRING), Field("n", Type.INT64), Field("d", Type.DATE), key="surface")
    filled, told = FilledTable("daily", table, lambda day: frag("SELECT event_type, count(*) AS n, d FROM {p} GROUP BY event_type, d", p=events.partition(day))), []
    days = days_of(spark, sf)
    if run_fills(spark, filled, iter(days), told.append) != len(told) or told != days:
        raise RuntimeError("a day was not told")
    return table.frame(spark)


# catalog and plans


@R.add("SELECT c_custkey AS k, c_name AS x, CAST(NULL AS VARCHAR) AS y FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_mktsegment FROM customer")
def table_update_nested(spark, sf):
    """A part added to a struct of a table that holds rows; old rows have none of it."""
    catalog = _catalog(spark)
    of = lambda *names: Table(TableId(_DS, "nested"), schema=Schema.of(Field("k", Type.INT64), Field.struct("s", *[Field(n, Type.STRING) for n in names])))
    catalog.delete_table(TableId(_DS, "nested"))
    _clear(spark, _DS, "nested")
    ensure, customer = deploy.EnsureUpdated(catalog), read(spark, sf, "customer")
    ensure.ensure(of("x"))
    write(customer.select(F.col("c_custkey").alias("k"), F.struct(F.col("c_name").alias("x")).alias("s")), of("x"), Disposition.APPEND)
    ensure.ensure(of("x", "y"))
    if not isinstance(ensure.check(of("x", "y")), deploy.Noop):
        raise RuntimeError("the catalog does not hold the new part")
    write(customer.select((F.col("c_custkey") + 1000000).alias("k"), F.struct(F.col("c_name").alias("x"), F.col("c_mktsegment").alias("y")).alias("s")), of("x", "y"), Disposition.APPEND)
    return spark.table(TableId(_DS, "nested").sql).select("k", "s.x", "s.y")


@R.add(_expected(("udf", "CreateRoutine Noop UpdateRoutine"), ("tvf", "CreateRoutine Noop UpdateRoutine"), ("udf again", "True"), ("tvf again", "True"), ("listed", "True"), ("gone", "True"), ("wrong kind", "Illegal")))
def routine_roundtrip(spark, sf):
    """Routines made, found again in another session, changed and dropped."""
    catalog = _catalog(spark)
    other = Catalog(spark.newSession())
    f = lambda add: Udf("trip_udf", (Param("x", _LONG),), frag(f"x + {add}"), _LONG, _DS)
    g = lambda add: Tvf("trip_tvf", (Param("n", _LONG),), frag(f"SELECT n + {add} AS a"), Schema.of(Field("a", Type.INT64)), _DS, "numbers")
    rows = []
    for label, r in (("udf", f), ("tvf", g)):
        catalog.delete_routine(r(1).name, _DS)
        rows.append((label, " ".join(type(x).__name__ for x in (deploy.EnsureUpdated(catalog).ensure(r(1)), deploy.EnsureUpdated(other).check(r(1)), deploy.EnsureUpdated(other).check(r(2))))))
        rows.append((f"{label} again", other.routine(r(1).name, _DS) == r(1) == routine_from_json(_DS, json.loads(json.dumps(routine_to_json(r(1)))))))
    rows.append(("listed", {"trip_udf", "trip_tvf"} <= set(other.list_routines(_DS))))
    rows.append(("wrong kind", type(deploy.plan_routine(f(1), g(1))).__name__))
    catalog.delete_routine("trip_udf", _DS)
    return _pairs(spark, [*rows, ("gone", other.routine("trip_udf", _DS) is None)])


@R.add(_expected(("dataset", "True"), ("listed", "True"), ("tables", "one two"), ("deleted", "two"), ("no dataset", "True"), ("definition", "True"), ("labels set and unset", "new"), ("illegal", "IllegalUpdate")))
def dataset_and_table_report(spark, sf):
    catalog, ds = Catalog(spark), DatasetRef(ProjectId("quill-tests"), "shortlived")
    catalog.delete_dataset(ds)
    catalog.create_dataset(ds)
    rows = [("dataset", catalog.dataset(ds) == ds), ("listed", ds in catalog.list_datasets(ds.project))]
    one = Table(TableId(ds, "one"), Day("d"), Schema(_EVENTS), "a table", TableLabels({"old": "x"}), options=TableOptions(partition_expiration_days=9))
    ensure = deploy.EnsureUpdated(catalog)
    ensure.ensure(one)
    ensure.ensure(Table(TableId(ds, "two"), schema=Schema(_EVENTS)))
    rows.append(("tables", " ".join(sorted(t.table for t in catalog.list_tables(ds)))))
    rows.append(("definition", catalog.table(one.id) == one))
    ensure.ensure(Table(one.id, one.partitioning, one.schema, one.description, TableLabels({"new": "y"}), options=one.options))
    rows.append(("labels set and unset", " ".join(k.removeprefix("label.") for k in catalog._properties(one.id.sql) if k.startswith("label."))))
    rows.append(("illegal", _error(lambda: ensure.ensure(Table(one.id, one.partitioning, Schema(_EVENTS[::-1]))))))
    catalog.delete_table(one.id)
    rows.append(("deleted", " ".join(t.table for t in catalog.list_tables(ds))))
    catalog.delete_dataset(ds)
    return _pairs(spark, [*rows, ("no dataset", catalog.dataset(ds) is None)])


def _definitions():
    id = lambda name: TableId.of("my-project", "ds", name)
    every = Schema.of(*[Field(t.value.lower(), t, description=f"a {t.value}") for t in Type if t not in (Type.STRUCT, Type.ARRAY)], Field.struct("s", Field.repeated("x", Type.INT64), Field("d", Type.DATE, Mode.REQUIRED)), Field("d", Type.DATE, policy_tags=("secret",)))
    for scheme in (Hour("d"), Day("d"), Month("d"), IntRange("int64", 0, 40, 5), Sharded()):
        yield Table(id(f"t_{type(scheme).__name__.lower()}"), scheme, every, "it's a \"table\"", TableLabels({"foo": "bar"}), clustering=("string",), options=TableOptions(True, 7))
    yield View(id("a_view"), Day("d"), every, query=frag("SELECT 'x' AS d"))
    yield MaterializedView(id("an_mv"), schema=every, query=frag("SELECT 1 AS int64"), refresh_interval_ms=5)


@R.add("SELECT name, true AS by_json, true AS by_source FROM (VALUES ('t_hour'), ('t_day'), ('t_month'), ('t_intrange'), ('t_sharded'), ('a_view'), ('an_mv')) x (name)")
def definition_roundtrip(spark, sf):
    """Definitions through the catalog's JSON, and through generated Python source."""
    out = []
    for d in _definitions():
        namespace: dict = {}
        exec(codegen.source(d), namespace)  # noqa: S102
        out.append((d.id.table, from_json(d.id.dataset, json.loads(json.dumps(to_json(d)))) == d, namespace[d.id.table.upper()] == d))
    return spark.createDataFrame(out, "name string, by_json boolean, by_source boolean")


@R.add(_expected(("by name", "[]"), ("by name, missing", "Expected field `c` to be part of [a, b]"), ("by name, type", "Expected field `b` to have type STRING, got INT64"), ("types", "[]"), ("types, other", "Expected field `value` to have type STRING, got INT64"), ("counts", "At s: expected 2 fields, got 1")))
def conformance_by_name(spark, sf):
    a, b = Field("a", Type.INT64), Field("b", Type.INT64)
    of = lambda t: TypeOf(Mode.NULLABLE, t)
    one, two = Schema.of(Field.struct("s", a)), Schema.of(Field.struct("s", a, b))
    return _pairs(spark, [
        ("by name", conforms.types_and_names(Schema.of(a, b), Schema.of(b, a))), ("by name, missing", conforms.types_and_names(Schema.of(a, b), Schema.of(Field("c", Type.INT64)))[0]),
        ("by name, type", conforms.types_and_names(Schema.of(a, b), Schema.of(b.with_type(Type.STRING)))[0]), ("types", conforms.only_types_of(of(Type.INT64), of(Type.INT64))),
        ("types, other", conforms.only_types_of(of(Type.INT64), of(Type.STRING))[0]), ("counts", conforms.field_counts(one, two)[0]),
    ])


# SQL text


@R.add(_expected(("ctes", "a b"), ("recursive", "False"), ("query", "True"), ("tables", "quill_orders quill_customer"), ("write", "False"), ("recursive cte", "True"), ("analysed", "k:INT64:NULLABLE n:INT64:NULLABLE"), ("declared function", "a:INT64"), ("parse error", "ParseException")))
def sql_text_report(spark, sf):
    """What is known of a statement before it runs."""
    sql = "WITH a AS (SELECT o_custkey AS k FROM quill_orders -- FROM nowhere\n), b AS (SELECT k, count(*) AS n FROM a GROUP BY k) SELECT b.k, n FROM b JOIN quill_customer c ON c.c_custkey = b.k WHERE c.c_name <> 'FROM x'"
    view(read(spark, sf, "orders"), "quill_orders")
    view(read(spark, sf, "customer"), "quill_customer")
    d = analysis.describe(spark, sql)
    numbers = Tvf("declared_numbers", (Param("n", _LONG),), frag("SELECT n AS a"), Schema.of(Field("a", Type.INT64)))
    with analysis.declared(spark, tvfs=[numbers]):
        declared = " ".join(f"{f.name}:{f.type.value}" for f in analysis.output_fields(spark, "SELECT * FROM declared_numbers(3)"))
    return _pairs(spark, [
        ("ctes", " ".join(d.ctes)), ("recursive", d.recursive), ("query", d.query), ("tables", " ".join(analysis.referenced_names(spark, sql))), ("write", analysis.is_query(spark, "INSERT INTO x SELECT 1")),
        ("recursive cte", analysis.describe(spark, "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r").recursive),
        ("analysed", " ".join(f"{f.name}:{f.type.value}:{f.mode.value}" for f in analysis.output_fields(spark, sql))), ("declared function", declared), ("parse error", _error(lambda: analysis.describe(spark, "SELEC 1"))),
    ])


@R.add("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01' GROUP BY 1")
def fragment_from_text(spark, sf):
    """SQL text becomes a fragment in which a partition stands for the table's name."""
    orders = view(read(spark, sf, "orders"), "quill_orders", Month("o_orderdate", raw=True))
    found = analysis.fragment_of(spark, "WITH x AS (SELECT * FROM quill_orders) SELECT o_custkey, count(*) AS n FROM x GROUP BY 1", {"quill_orders": [orders.partition(YearMonth(1996, 1))]})
    if found.partitions() != [orders.partition(YearMonth(1996, 1))]:
        raise RuntimeError("the partition is not in the lineage")
    return found.run(spark)


# checks


@R.add(_expected(*((k, "ok") for k in ("exact", "by name", "types", "none", "view", "fill", "tvf", "udf", "type", "union", "golden")), ("exact, swapped", "SchemaMismatch"), ("union, other", "SchemaMismatch"), ("udf, other", "AssertionError"), ("golden, other", "AssertionError"), ("failing", "ok"), ("not failing", "AssertionError")))
def checks_report(spark, sf):
    """Each check of the test kit, on what passes and what does not."""
    table = Table(TableId.of("my-project", "ds", "checked"), Day("d"), Schema(_EVENTS))
    q, wanted = frag("SELECT event_id, event_type, d FROM {p}", p=[table.partition(dt.date(2024, 1, k)) for k in (3, 4)]), Schema(_EVENTS)
    swapped, long = Schema(_EVENTS[::-1]), Schema.of(Field("n", Type.INT64))
    one = frag("SELECT 1L AS n")
    double = Udf("checked_double", (Param("x", _LONG),), frag("x * 2"), _LONG)
    path = Path(tempfile.mkdtemp(prefix="quill-golden-")) / "q.sql"
    golden(path, q.sql)
    cases = {
        "exact": lambda: check_query(spark, q, wanted), "by name": lambda: check_query(spark, q, swapped, Check.BY_NAME), "types": lambda: check_query(spark, q, wanted, Check.TYPES), "none": lambda: check_query(spark, q, swapped, Check.NONE),
        "exact, swapped": lambda: check_query(spark, q, swapped), "view": lambda: check_view(spark, View(TableId.of("my-project", "ds", "vv"), Day("d"), wanted, query=q)),
        "fill": lambda: check_fill(spark, FilledTable("f", table, lambda day: q).with_date(dt.date(2024, 1, 3))), "tvf": lambda: check_tvf(spark, Tvf("checked_tvf", (Param("x", _LONG),), frag("SELECT x AS n"), long), 1),
        "udf": lambda: check_udf(spark, double, (10,), 20), "udf, other": lambda: check_udf(spark, double, (10,), 21), "type": lambda: check_type(spark, one, _LONG),
        "union": lambda: check_queries(spark, [one, frag("SELECT 2L AS n")], long), "union, other": lambda: check_queries(spark, [one, frag("SELECT 'x' AS n")], long),
        "golden": lambda: golden(path, q.sql), "golden, other": lambda: golden(path, one.sql), "failing": lambda: check_fails(spark, frag("SELECT nowhere FROM {p}", p=table.partition(dt.date(2024, 1, 3)))), "not failing": lambda: check_fails(spark, one),
    }
    return _pairs(spark, [(k, "ok" if (e := _error(f)) == "none" else e) for k, f in cases.items()])


@R.add("SELECT name, value FROM (VALUES ('bool', 'true'), ('int64', '0'), ('float64', '1.5'), ('numeric', '2.000000000'), ('string', 'string'), ('date', '2020-01-01'), ('datetime', '2020-01-01 00:00:00'), ('geography', 'POINT(0 0)'), ('json', '{\"foo\": \"bar\"}'), ('interval', '{1, 6, 15000000}'), ('repeated', '[3, 3]'), ('struct', '{4, b}')) x (name, value)")
def example_values(spark, sf):
    """The example row of a table with columns of many types, shown as text."""
    schema = Schema.of(
        *[Field(t.value.lower(), t) for t in (Type.BOOL, Type.INT64, Type.FLOAT64, Type.NUMERIC, Type.STRING, Type.DATE, Type.DATETIME, Type.GEOGRAPHY, Type.JSON, Type.INTERVAL)],
        Field.repeated("repeated", Type.INT64), Field.struct("struct", Field("a", Type.INT64), Field("b", Type.STRING)),
    )
    row = spark.createDataFrame([example_row(schema)], schema.to_spark())
    return row.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("name"), F.col(f.name).cast("string").alias("value")) for f in schema])).alias("x")).select("x.name", "x.value")


# jobs


@R.add("SELECT 'Load' AS kind, count(*) AS n, true AS took, true AS bytes_known, true AS tasks_ran FROM events")
def job_statistics(spark, sf):
    events = view(events_by_day(spark, sf).select("event_id", "event_type", "d"), "quill_events_slim")
    table = _fresh(spark, "counted", Day("d"), *_EVENTS, key="surface")
    stats = Client(spark).submit(JobId("count_rows"), frag("SELECT * FROM {t}", t=events), table, Disposition.TRUNCATE)
    return spark.createDataFrame([(stats.kind, stats.rows, stats.seconds > 0, stats.input_bytes > 0, stats.task_ms > 0)], "kind string, n long, took boolean, bytes_known boolean, tasks_ran boolean")


@R.add(_expected(("ok", "1"), ("error", "1"), ("timeout", "1"), ("active", "0"), ("task time", "True"), ("histogram", "1"), ("retried", "3 ok"), ("gave up", "ConnectionError"), ("dry run of a write", "QuillError"), ("late", "JobTimeout"), ("bad id", "InvalidId")))
def metrics_report(spark, sf):
    """Counters after jobs that went well, failed, and ran out of time; retries."""
    m, orders = Metrics(), view(read(spark, sf, "orders"), "quill_orders")
    client = Client(spark, m)
    client.query(JobId("well"), frag("SELECT max(o_totalprice) AS x FROM {t}", t=orders))
    _error(lambda: client.query(JobId("badly"), frag("SELECT raise_error('no') AS x FROM {t}", t=orders)))
    late = _error(lambda: Client(spark, m, timeout_s=0.3).submit(JobId("slowly"), frag("SELECT count(*) AS n FROM range(0, 100000000000L, 1, 4) WHERE sqrt(id) < 0")))
    tries: list = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return "ok"

    patient = Retry(attempts=4, base_s=0.0)
    told = f"{patient.run(flaky, lambda e: True)}"
    text = m.exposition()
    return _pairs(spark, [
        ("ok", m.count["well", "ok"]), ("error", m.abnormal["badly", "error"]), ("timeout", m.abnormal["slowly", "timeout"]), ("active", sum(m.active.values())), ("task time", m.task_ms["well"] > 0),
        ("histogram", text.count('quill_job_duration_seconds_bucket{job="well",le="+Inf"} 1')), ("retried", f"{len(tries)} {told}"), ("gave up", _error(lambda: patient.run(_unreachable, lambda e: True))),
        ("dry run of a write", _error(lambda: client.dry_run("DROP TABLE nothing"))), ("late", late), ("bad id", _error(lambda: ProjectId("A"))),
    ])


def _unreachable():
    raise ConnectionError


QUERIES, ORACLES = R.queries, R.oracles
