import datetime as dt
import logging

import pytest
from pyspark.sql import functions as F

from quillspark import Day, Field, IntRange, MaterializedView, Mode, Schema, Sharded, Table, TableId, Type, View, frag
from quillspark.client import Client, JobId, Metrics, Retry
from quillspark.errors import DuplicateKeys, IllegalUpdate, JobTimeout, QuillError, RequiredNull, SchemaMismatch
from quillspark.functions.routines import Param, Tvf, Udf
from quillspark.ids import DatasetRef, ProjectId, TableLabels
from quillspark.partition import Hour, Month, Start
from quillspark.plans import analysis, codegen, conforms, deploy
from quillspark.plans.catalog import Catalog
from quillspark.queries.base import events_by_day, view
from quillspark.sources.extract import Avro, Csv, JsonLines, Parquet, extract
from quillspark.sources.load import Disposition, delete_where, load_hashed, load_json, load_rows, merge_into, update_where, write
from quillspark.sources.partitions import expire_partitions, list_partitions, table_metadata
from quillspark.sources.temporary import copy_dataset, create_temporary, drop_expired, temporary_table
from quillspark.tables import TableOptions
from quillspark.types import TypeOf

DS = DatasetRef(ProjectId("quill-tests"), "unit")
D = dt.date(2024, 1, 3)


@pytest.fixture(scope="module")
def catalog(spark):
    c = Catalog(spark)
    c.delete_dataset(DS)
    c.create_dataset(DS)
    yield c
    c.delete_dataset(DS)


def defined(name, scheme=None, **more):
    return Table(TableId(DS, name), scheme or Day("d"), Schema.of(Field("id", Type.INT64, Mode.REQUIRED, "number"), Field("t", Type.STRING), Field("d", Type.DATE)), "a table", TableLabels({"foo": "bar"}), **more)


def fields(*names):
    return Schema.of(*[Field(n, Type.INT64, Mode.REQUIRED) for n in names])


def test_conformance():
    a, b = Field("one", Type.STRING), Field("two", Type.INT64)
    given, swapped = Schema.of(a, b), Schema.of(b, a)
    assert conforms.only_types(given, given) == [] and conforms.field_counts(given, given) == []
    assert conforms.only_types(given, swapped)[0] == "Expected field `two`, got field `one`"
    assert conforms.types_and_names(given, swapped) == []
    assert conforms.only_types(given, Schema.of(a)) == [] and "0-based index 1" in conforms.only_types(Schema.of(a), given)[0]
    assert conforms.field_counts(Schema.of(a), given) == ["At root: expected 2 fields, got 1"]
    assert "to be part of [one]" in conforms.types_and_names(Schema.of(a), given)[0]
    assert "to have mode REPEATED" in conforms.only_types(Schema.of(a), Schema.of(a.with_mode(Mode.REPEATED)))[0]
    assert "to have type INT64" in conforms.only_types(Schema.of(a), Schema.of(a.with_type(Type.INT64)))[0]


def test_plans():
    old = Table(TableId(DS, "tt"), schema=fields("a", "b"))
    of = lambda *names: Table(TableId(DS, "tt"), schema=fields(*names))
    assert isinstance(deploy.plan(old, None), deploy.Create)
    assert isinstance(deploy.plan(old, old), deploy.Noop)
    assert isinstance(deploy.plan(of("a", "b", "c"), old), deploy.Update)
    wrong = deploy.plan(of("a", "c", "b"), old)
    assert isinstance(wrong, deploy.IllegalExtension) and "Expected field `b`, got field `c`" in wrong.reason
    nested = lambda *names: Table(TableId(DS, "tt"), schema=Schema.of(Field.struct("b", *fields(*names))))
    assert isinstance(deploy.plan(nested("a", "b"), nested("a")), deploy.Update)
    assert "Expected field `b.b`, got field `b.c`" in deploy.plan(nested("a", "c"), nested("a", "b")).reason
    assert isinstance(deploy.plan(Table(TableId(DS, "tt"), IntRange("a"), fields("a", "b")), old), deploy.UnsupportedPartitioning)
    v = View(TableId(DS, "tt"), schema=fields("a"), query=frag("SELECT 1L AS a"))
    assert type(deploy.plan(v, old)) is deploy.Illegal
    assert isinstance(deploy.plan(View(v.id, schema=v.schema, query=frag("SELECT 2L AS a")), v), deploy.Recreate)
    assert isinstance(deploy.plan(View(v.id, Day("a"), v.schema, query=v.query), v), deploy.Noop)
    mv = MaterializedView(TableId(DS, "tt"), schema=fields("a"), query=frag("SELECT 1L AS a"))
    assert isinstance(deploy.plan(MaterializedView(mv.id, schema=mv.schema.recursively_nullable(), query=mv.query), mv), deploy.Noop)
    f = Udf("ff", (Param("x", TypeOf(Mode.NULLABLE, Type.INT64)),), frag("x"), TypeOf(Mode.NULLABLE, Type.INT64), DS)
    assert isinstance(deploy.plan_routine(f, f), deploy.Noop) and isinstance(deploy.plan_routine(f, None), deploy.CreateRoutine)
    assert isinstance(deploy.plan_routine(Udf("ff", f.params, frag("x + 1"), f.returns, DS), f), deploy.UpdateRoutine)


def test_tables_in_the_catalog(spark, catalog):
    t = defined("orders")
    ensure = deploy.EnsureUpdated(catalog)
    assert isinstance(ensure.ensure(t), deploy.Create)
    assert catalog.table(t.id) == t and isinstance(ensure.check(t), deploy.Noop)
    wider = Table(t.id, t.partitioning, t.schema.extend([Field("more", Type.FLOAT64)]), "other", TableLabels({"new": "x"}))
    assert isinstance(ensure.ensure(wider), deploy.Update)
    assert catalog.table(t.id) == wider and wider.frame(spark).columns == ["id", "t", "d", "more"]
    assert "label.foo" not in catalog._properties(t.id.sql)
    with pytest.raises(IllegalUpdate):
        ensure.perform(ensure.check(t))
    assert t.id in catalog.list_tables(DS) and DS in catalog.list_datasets(DS.project)
    namespace = {}
    exec(codegen.source(wider), namespace)  # noqa: S102
    assert namespace["ORDERS"] == wider
    catalog.delete_table(t.id)
    assert catalog.table(t.id) is None


def test_parts_of_structs_reach_the_catalog(spark, catalog):
    of = lambda *names: Table(TableId(DS, "nested"), schema=Schema.of(Field("k", Type.INT64), Field.struct("s", *[Field(n, Type.INT64) for n in names])))
    ensure = deploy.EnsureUpdated(catalog)
    ensure.ensure(of("x"))
    spark.sql("SELECT 1L AS k, named_struct('x', 2L) AS s").write.insertInto(TableId(DS, "nested").sql)
    assert isinstance(ensure.ensure(of("x", "y")), deploy.Update) and isinstance(ensure.check(of("x", "y")), deploy.Noop)
    assert spark.table(of("x").id.sql).schema["s"].dataType.simpleString() == "struct<x:bigint,y:bigint>"
    spark.sql("SELECT 3L AS k, named_struct('x', 4L, 'y', 5L) AS s").write.insertInto(TableId(DS, "nested").sql)
    assert sorted((r.k, r.s.x, r.s.y) for r in spark.table(of("x").id.sql).collect()) == [(1, 2, None), (3, 4, 5)]
    # a column that the definition does not know shows
    spark.sql(f"ALTER TABLE {of('x').id.sql} ADD COLUMNS (own STRING)")
    assert catalog.table(of("x").id).schema.names == ["k", "s", "own"]


def test_routines_outlive_the_session(spark, catalog):
    long = TypeOf(Mode.NULLABLE, Type.INT64)
    f = Udf("kept_udf", (Param("x", long),), frag("x + 1"), long, DS)
    g = Tvf("kept_tvf", (Param("n", long),), frag("SELECT n AS a"), Schema.of(Field("a", Type.INT64)), DS, "numbers")
    for r in (f, g):
        deploy.EnsureUpdated(catalog).ensure(r)
    other = Catalog(spark.newSession())
    assert other.routine("kept_udf", DS) == f and other.routine("kept_tvf", DS) == g and other.routine("none", DS) is None
    assert isinstance(deploy.EnsureUpdated(other).check(f), deploy.Noop)
    assert isinstance(deploy.EnsureUpdated(other).check(Udf("kept_udf", f.params, frag("x + 2"), long, DS)), deploy.UpdateRoutine)
    other.delete_routine("kept_udf", DS)
    assert catalog.routine("kept_udf", DS) is None


def test_parameters_without_types(spark):
    same = Udf("same_twice", (Param("x"), Param("n", TypeOf(Mode.NULLABLE, Type.INT64))), frag("concat(x, '-', n)"), TypeOf(Mode.NULLABLE, Type.STRING))
    row = frag("SELECT {a} AS a, {b} AS b, {c} AS c FROM range(1)", a=same("t", 1), b=same(frag("id + 5"), 2), c=same(dt.date(2024, 1, 2), 3)).run(spark).first()
    assert tuple(row) == ("t-1", "5-2", "2024-01-02-3")
    with pytest.raises(TypeError, match="without types"):
        Udf("same_there", same.params, same.body, same.returns, DS)("t", 1)


def test_deletes_updates_and_merges_of_partitions(spark, catalog):
    t, s = defined("changed"), defined("changes")
    for x in (t, s):
        catalog.create_table(x)
    load_rows(spark, t, [{"id": k, "t": "old", "d": f"2024-01-0{1 + k % 3}"} for k in range(9)] + [{"id": 9, "t": "old"}])
    delete_where(t, F.col("id").isin(0, 3, 6, 1))
    assert sorted(r.id for r in t.frame(spark).collect()) == [2, 4, 5, 7, 8, 9] and "d=2024-01-01" not in [r[0] for r in spark.sql(f"SHOW PARTITIONS {t.id.sql}").collect()]
    update_where(t, F.col("id") > 7, {"t": F.lit("set")})
    assert {r.id: r.t for r in t.frame(spark).collect()} == {2: "old", 4: "old", 5: "old", 7: "old", 8: "set", 9: "set"}
    with pytest.raises(QuillError, match="cannot be set"):
        update_where(t, F.lit(True), {"d": F.lit(None)})
    delete_where(t, F.col("d").isNull())
    load_rows(spark, s, [{"id": 4, "t": "new", "d": "2024-01-02"}, {"id": 40, "t": "new", "d": "2024-01-02"}, {"id": 5, "t": "no", "d": "2024-01-03"}])
    merge_into(s.partition(dt.date(2024, 1, 2)), t.partition(dt.date(2024, 1, 2)), ["id"])
    assert {r.id: r.t for r in t.frame(spark).collect()} == {2: "old", 4: "new", 40: "new", 5: "old", 7: "old", 8: "set"}
    with pytest.raises(QuillError, match="outside"):
        merge_into(s.partition(dt.date(2024, 1, 3)), t.partition(dt.date(2024, 1, 2)), ["id"])
    with pytest.raises(DuplicateKeys, match="several rows"):
        merge_into(s.frame(spark).union(s.frame(spark)), t, ["id"])
    with pytest.raises(TypeError, match="schema"):
        merge_into(view(s.frame(spark), "test_merge_ref", Day("d")).partition(D), t, ["id"])
    assert not [x for x in catalog.list_tables(DS) if "__" in x.table]


def test_rows_in_parts_go_in_by_one_write(spark, catalog, monkeypatch):
    from quillspark.sources import load

    monkeypatch.setattr(load, "ROWS", 3)
    t = defined("parts")
    catalog.create_table(t)
    assert load_rows(spark, t, ({"id": k, "d": "2024-01-03"} for k in range(10)), Disposition.TRUNCATE) == 10
    assert t.frame(spark).count() == 10 and not [x for x in catalog.list_tables(DS) if "loading" in x.table]


def test_views_and_routines(spark, catalog):
    long = TypeOf(Mode.NULLABLE, Type.INT64)
    v = View(TableId(DS, "vv"), schema=Schema.of(Field("a", Type.INT64)), query=frag("SELECT 1L AS a"))
    ensure = deploy.EnsureUpdated(catalog)
    ensure.ensure(v)
    assert isinstance(ensure.check(v), deploy.Noop) and spark.table(v.id.sql).first().a == 1
    ensure.ensure(View(v.id, schema=v.schema, query=frag("SELECT 2L AS a")))
    assert spark.table(v.id.sql).first().a == 2
    mv = MaterializedView(TableId(DS, "mv"), schema=v.schema, query=frag("SELECT 3L AS a"))
    ensure.ensure(mv)
    assert spark.table(mv.id.sql).first().a == 3 and not catalog.refresh(mv) and catalog.refresh(MaterializedView(mv.id, schema=mv.schema, query=mv.query, refresh_interval_ms=0))
    f = Udf("plus_one", (Param("x", long),), frag("x + 1"), long, DS)
    g = Tvf("numbers", (Param("n", long),), frag("SELECT n AS a"), v.schema, DS)
    for r in (f, g):
        assert isinstance(ensure.ensure(r), deploy.CreateRoutine) and isinstance(ensure.check(r), deploy.Noop)
    assert frag("SELECT {x} AS x FROM {t}", x=f(frag("a")), t=g(4)).run(spark).first().x == 5
    assert {"plus_one", "numbers"} <= set(catalog.list_routines(DS))
    catalog.delete_routine("plus_one", DS)
    assert "plus_one" not in catalog.list_routines(DS)


def test_loads_and_partitions(spark, catalog, tmp_path):
    t = defined("loads", options=TableOptions(partition_expiration_days=10))
    catalog.create_table(t)
    assert load_rows(spark, t, []) is None
    assert load_rows(spark, t.partition(D), [{"id": 1, "t": "x'y", "d": "2024-01-03"}, {"id": 2, "d": "2024-01-03"}]) == 2
    with pytest.raises(RequiredNull):
        load_rows(spark, t, [{"t": "no id", "d": "2024-01-03"}])
    with pytest.raises(QuillError, match="outside"):
        load_rows(spark, t.partition(D), [{"id": 1, "d": "2024-01-04"}])
    with pytest.raises(QuillError, match="outside"):
        load_rows(spark, t.partition(D), [{"id": 1, "d": "2024-01-04"}], Disposition.TRUNCATE)
    for where in (t, t.partition(D)):
        with pytest.raises(RequiredNull):
            load_rows(spark, where, [{"d": "2024-01-03"}], Disposition.TRUNCATE)
    assert t.frame(spark).count() == 2  # a write that fails leaves what was there
    write(t.frame(spark).limit(0), t.partition(dt.date(2024, 5, 5)), Disposition.TRUNCATE)
    with pytest.raises(QuillError, match="not empty"):
        load_rows(spark, t.partition(D), [{"id": 3, "d": "2024-01-03"}], Disposition.EMPTY)
    load_rows(spark, t, [{"id": 4, "d": "2024-01-09"}, {"id": 5, "d": "2024-01-20"}, {"id": 6}])
    load_rows(spark, t.partition(D), [{"id": 9, "d": "2024-01-03"}], Disposition.TRUNCATE)
    listed = list_partitions(spark, t, with_rows=True)
    assert [(p.value.day, m.rows) for p, m in listed] == [(20, 1), (9, 1), (3, 1)] and all(m.bytes > 0 for _, m in listed)
    assert [p.value.day for p, _ in list_partitions(spark, t, Start(dt.date(2024, 1, 9)))] == [20, 9]
    assert [p.value.day for p in expire_partitions(spark, t, dt.date(2024, 1, 21))] == [9, 3]
    assert sorted(r.id for r in t.frame(spark).collect()) == [5, 6]
    (tmp_path / "x.json").write_text('{"id": 7, "d": "2024-02-01"}\n')
    load_json(spark, t, str(tmp_path / "x.json"))
    assert t.frame(spark).count() == 3
    with pytest.raises(SchemaMismatch):
        write(spark.range(1).withColumnRenamed("id", "what"), t)
    assert table_metadata(spark, t, with_rows=True).rows == 3


def test_other_schemes(spark, catalog, sf):
    r = Table(TableId(DS, "hashed"), IntRange("part", 0, 50, 10), Schema.of(Field("name", Type.STRING), Field("part", Type.INT64)))
    catalog.create_table(r)
    load_hashed(spark.sql("SELECT string(id) AS name FROM range(200)"), r, "name")
    values = [p.value for p, _ in list_partitions(spark, r)]
    assert values == sorted(values, reverse=True) and max(values) < 50
    write(spark.createDataFrame([("only", 12)], "name string, part long"), r.partition(15), Disposition.TRUNCATE)
    write(spark.createDataFrame([], "name string, part long"), r.partition(25), Disposition.TRUNCATE)
    assert r.frame(spark).where("part between 20 and 29").count() == 0
    assert r.frame(spark).where("part between 10 and 19").count() == 1
    s = Table(TableId(DS, "shards"), Sharded(), Schema.of(Field("x", Type.INT64)))
    for k in (1, 2):
        write(spark.range(k).select(F.col("id").alias("x")), s.partition(dt.date(2024, 1, k)))
    assert [(p.value.day, m.rows) for p, m in list_partitions(spark, s, with_rows=True)] == [(2, 2), (1, 1)]
    events = events_by_day(spark, sf)
    for scheme in (Hour("p"), Month("p")):
        t = view(events.withColumn("p", scheme.bucket(F.col("ts"))), f"test_{type(scheme).__name__}", scheme)
        found = list_partitions(spark, t, with_rows=True)
        assert sum(m.rows for _, m in found) == events.count()


def test_extract_combinations(spark, tmp_path):
    df = spark.range(3)
    for fmt, bad in ((Csv(), "zstd"), (JsonLines(), "snappy"), (Parquet(), "lzo"), (Avro(), "zstd")):
        with pytest.raises(QuillError):
            extract(df, str(tmp_path / "x"), fmt, bad)
    for fmt in (Csv(), JsonLines(), Parquet()):
        for c in fmt.compressions:
            extract(df, str(tmp_path / f"{fmt.name}-{c}"), fmt, c)
    with pytest.raises(QuillError, match="Avro"):
        extract(df, str(tmp_path / "a"), Avro(), "snappy")


def test_temporary_tables_and_copies(spark, catalog):
    t = defined("source")
    catalog.create_table(t)
    load_rows(spark, t, [{"id": 1, "d": "2024-01-03"}])
    with temporary_table(spark, t, DS) as own:
        assert own.id != t.id and own.frame(spark).count() == 0
    assert not spark.catalog.tableExists(own.id.sql)
    left = create_temporary(spark, t, DS, expiry_s=-1)
    assert drop_expired(spark, DS) == [left.id.table]
    other = DatasetRef(DS.project, "copied")
    status = copy_dataset(spark, DS, other)
    assert status.state in ("SUCCEEDED", "FAILED")
    assert spark.table(TableId(other, "source").sql).count() == 1 and catalog.table(TableId(other, "source")).labels == t.labels
    catalog.delete_dataset(other)


def test_analysis(spark):
    t = Table(TableId.local("declared_orders"), schema=Schema.of(Field("d", Type.DATE, Mode.REQUIRED), Field("b", Type.INT64)))
    with analysis.declared(spark, [t]):
        sql = "WITH x AS (SELECT d, count_if(b IS NULL) AS n FROM declared_orders GROUP BY 1) SELECT d, n, array(n) AS ns FROM x"
        assert [(f.name, f.type, f.mode) for f in analysis.output_fields(spark, sql)] == [("d", Type.DATE, Mode.NULLABLE), ("n", Type.INT64, Mode.NULLABLE), ("ns", Type.INT64, Mode.REPEATED)]
        assert analysis.referenced_names(spark, sql) == ["declared_orders"]
        assert analysis.describe(spark, sql) == analysis.Described(True, ("x",), False)
        two = "SELECT a.b FROM declared_orders a JOIN (SELECT max(b) AS m FROM declared_orders) y ON a.b = y.m WHERE a.b IN (SELECT b FROM declared_orders)"
        f = analysis.fragment_of(spark, two, {"declared_orders": t})
        assert f.tables() == [t] and f.run(spark).columns == ["b"] and sum(p is t for p in f.parts) == 3
        day = Table(t.id, Day("d"), t.schema)
        pruned = analysis.fragment_of(spark, sql, {"declared_orders": [day.partition(D)]})
        assert pruned.partitions() == [day.partition(D)] and pruned.run(spark).count() == 0
    assert analysis.describe(spark, "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r").recursive
    assert not analysis.is_query(spark, "DROP TABLE x") and not analysis.is_query(spark, "INSERT INTO a SELECT 1") and analysis.is_query(spark, "SELECT 1")


def test_client(spark, catalog, caplog):
    m = Metrics()
    c = Client(spark, m)
    assert c.query(JobId("one"), frag("SELECT {x} AS x", x="it's"), str) == ["it's"]
    assert list(c.stream(JobId("two"), frag("SELECT id FROM range(5)"), int)) == list(range(5))
    assert c.query(JobId("few"), frag("SELECT id FROM range(50)"), int, limit=2) == [0, 1]
    c.query(JobId("busy"), frag("SELECT count(*) AS n FROM range(20000000) WHERE sqrt(id) > 5"))
    assert m.task_ms["busy"] > 0 and m.count["two", "ok"] == 1 and m.active["two"] == 0
    with pytest.raises(JobTimeout):
        list(Client(spark, m, timeout_s=0.5).stream(JobId("endless"), frag("SELECT count(*) AS n FROM range(0, 100000000000L, 1, 4) WHERE sqrt(id) < 0")))
    half = c.stream(JobId("half"), frag("SELECT id FROM range(5)"), int)
    assert next(half) == 0
    half.close()
    assert m.abnormal["half", "abandoned"] == 1
    once = []

    def fails_once():
        once.append(1)
        if len(once) == 1:
            raise ConnectionError
        return 7

    patient = Client(spark, m, retry=Retry(attempts=3, base_s=0.0))
    assert patient._run(JobId("again"), "Query", fails_once, spark.range(1))[0] == 7 and len(once) == 2
    dry = c.dry_run(frag("SELECT 1L AS a"))
    assert dry.schema.names == ["a"]
    with pytest.raises(QuillError):
        c.dry_run("DROP TABLE nothing")
    t = defined("submitted")
    catalog.create_table(t)
    stats = c.submit(JobId("three"), frag("SELECT 1L AS id, 'x' AS t, DATE'2024-01-03' AS d"), t.partition(D), Disposition.TRUNCATE)
    assert stats.kind == "Load" and t.frame(spark).count() == 1
    assert 'quill_jobs_total{job="one",outcome="ok"} 1' in m.exposition() and 'le="+Inf"' in m.exposition()
    strict = Table(TableId.local("strict_table"), Day("d"), t.schema, options=TableOptions(partition_filter_required=True))
    with pytest.raises(QuillError, match="filter"):
        c.frame(frag("SELECT * FROM {t}", t=strict.whole_table))
    with pytest.raises(JobTimeout):
        Client(spark, m, timeout_s=0.5).submit(JobId("slow"), frag("SELECT count(*) FROM range(0, 100000000000L, 1, 4) WHERE sqrt(id) < 0"))
    assert m.abnormal["slow", "timeout"] == 1 and JobId.auto().name.endswith("test_client")
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert Retry().run(flaky, lambda e: isinstance(e, OSError), sleep=lambda s: None) == "ok"
    with caplog.at_level(logging.INFO):
        from quillspark.streaming.fills import log_rows

        assert list(log_rows(iter(range(3)), 2)) == [0, 1, 2]
    assert "3 rows in all" in caplog.text
