import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from quillspark import Day, Field, Mode, Schema, Table, TableId, Type, View, frag
from quillspark.errors import SchemaMismatch
from quillspark.functions.routines import Param, Tvf, Udf
from quillspark.streaming.fills import Progress, fill_stream, windowed_counts
from quillspark.tables import FilledTable
from quillspark.testkit.checks import Check, check_fails, check_fill, check_queries, check_query, check_tvf, check_type, check_udf, check_view, example_row, golden
from quillspark.types import TypeOf

USERS = Table(TableId.of("my-project", "ds", "users"), schema=Schema.of(Field("user_id", Type.STRING, Mode.REQUIRED), Field.struct("names", Field("first", Type.STRING, Mode.REQUIRED), Field("middle", Type.STRING))))
LOG = Table(TableId.of("my-project", "ds", "log"), Day("d"), Schema.of(Field("user_id", Type.STRING, Mode.REQUIRED), Field("d", Type.DATE), Field.repeated("tags", Type.STRING), Field("n", Type.INT64)))
LONG = TypeOf(Mode.NULLABLE, Type.INT64)


def test_example_rows_of_every_type(spark):
    schema = Schema.of(*[Field(t.value.lower(), t) for t in Type if t not in (Type.STRUCT, Type.ARRAY)], Field.struct("s", Field.repeated("x", Type.INT64)))
    got = spark.createDataFrame([example_row(schema)], schema.to_spark()).drop("time")
    assert got.count() == 1


def test_query_without_data(spark):
    q = frag("SELECT l.d, l.n, u.names.first AS first, l.tags FROM {l} l LEFT JOIN {u} u USING (user_id)", l=LOG.partition(dt.date(2024, 5, 6)), u=USERS)
    wanted = Schema.of(Field("d", Type.DATE), Field("n", Type.INT64), Field("first", Type.STRING), Field.repeated("tags", Type.STRING))
    assert check_query(spark, q, wanted).names == wanted.names
    check_query(spark, q, Schema(tuple(reversed(wanted.fields))), Check.BY_NAME)
    with pytest.raises(SchemaMismatch, match="Expected field"):
        check_query(spark, q, Schema(tuple(reversed(wanted.fields))))
    check_view(spark, View(TableId.of("my-project", "ds", "vv"), schema=wanted, query=q))
    filled = FilledTable("j", LOG, lambda d: frag("SELECT * FROM {p}", p=LOG.partition(d)))
    check_fill(spark, filled.with_date(dt.date(2024, 1, 1)))
    check_type(spark, frag("SELECT n FROM {l}", l=LOG.whole_table), LONG)


def test_names_in_other_places_stay(spark):
    longer = Table(TableId.of("my-project", "ds", "users_more"), schema=USERS.schema)
    q = frag("SELECT u.user_id, {s} AS s FROM {u} u JOIN {m} m USING (user_id)", s=f"from {USERS.id.sql} x", u=USERS, m=longer)
    assert check_query(spark, q, Schema.of(Field("user_id", Type.STRING), Field("s", Type.STRING))).names == ["user_id", "s"]
    inner = View(TableId.of("my-project", "ds", "inner_view"), schema=USERS.schema, query=frag("SELECT * FROM {u}", u=USERS))
    outer = View(TableId.of("my-project", "ds", "outer_view"), schema=USERS.schema, query=frag("SELECT * FROM {v}", v=inner))
    check_query(spark, frag("SELECT user_id FROM {v}", v=outer), Schema.of(Field("user_id", Type.STRING)))


def test_several_queries_by_their_union(spark):
    one, two = frag("SELECT n FROM {l}", l=LOG.whole_table), frag("SELECT 1L AS n")
    check_queries(spark, [one, two], Schema.of(Field("n", Type.INT64)))
    with pytest.raises(SchemaMismatch):
        check_queries(spark, [one, frag("SELECT 'x' AS other")], Schema.of(Field("n", Type.INT64)))
    with pytest.raises(SchemaMismatch, match="fields"):
        check_queries(spark, [one, frag("SELECT 1L AS n, 2L AS m")], Schema.of(Field("n", Type.INT64)))


def test_functions(spark):
    double = Udf("kit_double", (Param("x", LONG),), frag("x * 2"), LONG)
    check_udf(spark, double, (10,), 20)
    with pytest.raises(AssertionError):
        check_udf(spark, double, (10,), 21)
    check_tvf(spark, Tvf("kit_tvf", (Param("x", LONG),), frag("SELECT x AS a"), Schema.of(Field("a", Type.INT64))), 1)


def test_failing_queries(spark):
    assert "nowhere" in check_fails(spark, frag("SELECT nowhere FROM {l}", l=LOG.whole_table))
    with pytest.raises(AssertionError):
        check_fails(spark, frag("SELECT n FROM {l}", l=LOG.whole_table))


def test_golden(tmp_path):
    path = tmp_path / "a" / "q.sql"
    golden(path, "SELECT 1")
    golden(path, "SELECT 1")
    with pytest.raises(AssertionError):
        golden(path, "SELECT 2")
    golden(path, "SELECT 2", update=True)


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    source = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(source))
    listener = Progress()
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(schema).parquet(str(source)).withColumn("d", F.lit(None).cast("date"))
    q = fill_stream(stream, Day("d"), str(tmp_path / "out"), str(tmp_path / "cp"), event_time="ts")
    q.awaitTermination(120)
    got = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out" / "batch=0"))
    assert got.count() == spark.read.parquet(str(source)).count() and got.where("d <> date(ts)").count() == 0
    counted = windowed_counts(spark.readStream.schema(schema).parquet(str(source)), "ts", "1 hour", "1 day", "event_type")
    q = counted.writeStream.format("memory").queryName("quill_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM quill_counts").first()[0] == got.count()
    time.sleep(1)
    spark.streams.removeListener(listener)
    assert listener.batches


def test_many_partitions_in_one_write(spark):
    import datetime as dt

    import pytest

    from quillspark import Day, Field, IntRange, Month, Schema, Sharded, Table, TableId, Type, frag
    from quillspark.errors import QuillError
    from quillspark.literals import YearMonth
    from quillspark.plans.catalog import Catalog
    from quillspark.sources.load import run_fills_together, write_partitions
    from quillspark.tables import FilledTable

    id = TableId.of("my-project", "many", "rows")
    Catalog(spark).create_dataset(id.dataset)

    def fresh(name, scheme, type):
        table = Table(id.with_table(name), scheme, Schema.of(Field("v", Type.INT64), Field("d", type)))
        Catalog(spark).create_table(table)
        return table

    def rows(table):
        return sorted((r["v"], str(r["d"])) for r in table.frame(spark).collect())

    days = [dt.date(2024, 1, k) for k in (1, 2, 3)]
    table = fresh("by_day", Day("d"), Type.DATE)
    of = lambda *found: spark.createDataFrame(list(found), "v long, d date")
    write_partitions(of((1, days[0]), (2, days[1]), (3, days[2])), [table.partition(d) for d in days])
    # the third day stays, the second one has no rows now
    write_partitions(of((4, days[0]), (5, days[0])), [table.partition(d) for d in days[:2]])
    assert rows(table) == [(3, "2024-01-03"), (4, "2024-01-01"), (5, "2024-01-01")]
    with pytest.raises(QuillError, match="outside"):
        write_partitions(of((6, days[0]), (7, days[2])), [table.partition(d) for d in days[:2]])
    with pytest.raises(QuillError, match="outside"):
        write_partitions(of((6, days[0]), (7, None)), [table.partition(d) for d in days])
    write_partitions(of(), [])
    assert len(rows(table)) == 3

    # each fill may only have rows of its own day
    fills = FilledTable("f", table, lambda d: frag(f"SELECT 10L AS v, DATE '{d}' AS d"))
    run_fills_together(spark, [fills.with_date(d) for d in days])
    assert rows(table) == [(10, str(d)) for d in days]
    wrong = FilledTable("f", table, lambda d: frag("SELECT 11L AS v, DATE '2024-01-01' AS d"))
    with pytest.raises(QuillError, match="outside"):
        run_fills_together(spark, [wrong.with_date(d) for d in days])
    assert rows(table) == [(10, str(d)) for d in days]

    months = fresh("by_month", Month("d"), Type.DATE)
    ids = [months.partition(YearMonth(2024, m)) for m in (1, 2)]
    write_partitions(of((1, dt.date(2024, 1, 1)), (2, dt.date(2024, 2, 1))), ids)
    write_partitions(of((3, dt.date(2024, 2, 1))), ids)
    assert rows(months) == [(3, "2024-02-01")]
    windows = Table(id, IntRange("d", 0, 100, 10), Schema.of(Field("v", Type.INT64), Field("d", Type.INT64)))
    shards = Table(id, Sharded(), Schema.of(Field("v", Type.INT64)))
    for parts in ([windows.partition(10)], [shards.partition(days[0])], [table.partition(days[0]), months.partition(YearMonth(2024, 1))]):
        with pytest.raises(TypeError):
            write_partitions(of(), parts)
