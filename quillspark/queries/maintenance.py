"""Catalog, planning, lineage, test kit, streams: what they give, as frames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillspark.client import Client, JobId
from quillspark.fragment import frag
from quillspark.functions.routines import Param, Tvf, Udf
from quillspark.ids import DatasetRef, ProjectId, TableId
from quillspark.partition import Day, IntRange, Sharded
from quillspark.plans import analysis, conforms, deploy
from quillspark.plans.catalog import Catalog
from quillspark.queries.base import Registry, days_of, events_by_day, read, total, view
from quillspark.queries.writing import _clear, _fresh
from quillspark.sources.load import Disposition, load_hashed, write
from quillspark.sources.partitions import list_partitions
from quillspark.sources.temporary import copy_dataset, temporary_table
from quillspark.streaming.fills import windowed_counts
from quillspark.tables import FilledTable, MaterializedView, Table, View
from quillspark.testkit.checks import example_tables
from quillspark.types import Field, Mode, Schema, Type, TypeOf

R = Registry()
_DAY = dt.date(2024, 1, 3)
_LONG = TypeOf(Mode.NULLABLE, Type.INT64)
_FIELDS = (Field("event_id", Type.INT64), Field("event_type", Type.STRING), Field("d", Type.DATE))


def _loaded(spark, sf, name, key="upkeep"):
    table = _fresh(spark, name, Day("d"), *_FIELDS, key=key)
    write(events_by_day(spark, sf).select("event_id", "event_type", "d"), table, Disposition.APPEND)
    return table


_COUNTS = "SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1"


@R.add(_COUNTS)
def partition_listing_catalog(spark, sf):
    """From the catalog and the files, with counts."""
    found = list_partitions(spark, _loaded(spark, sf, "listed"), with_rows=True)
    return spark.createDataFrame([(p.value, m.rows) for p, m in found], "d date, n long")


@R.add(_COUNTS)
def shard_listing(spark, sf):
    table = Table(TableId(DatasetRef(ProjectId("quill-tests"), "upkeep"), "sharded"), Sharded(), Schema(_FIELDS[:2]))
    Catalog(spark).create_dataset(table.id.dataset)
    events = events_by_day(spark, sf)
    for day in days_of(spark, sf):
        p = table.partition(day)
        spark.sql(f"DROP TABLE IF EXISTS {p.table_id.sql}")
        _clear(spark, table.id.dataset, p.table_id.spark_name)
        write(events.where(F.col("d") == F.lit(day)).select("event_id", "event_type"), p, Disposition.EMPTY)
    return spark.createDataFrame([(p.value, m.rows) for p, m in list_partitions(spark, table, with_rows=True)], "d date, n long")


@R.add("SELECT CAST('0x' || substring(sha256(c_name), 1, 14) AS BIGINT) % 50 AS part, count(*) AS n FROM customer GROUP BY 1")
def hashed_load_roundtrip(spark, sf):
    table = _fresh(spark, "hashed", IntRange("part", 0, 50, 1), Field("c_name", Type.STRING), Field("part", Type.INT64), key="upkeep")
    load_hashed(read(spark, sf, "customer").select("c_name"), table, "c_name")
    return table.frame(spark).groupBy("part").agg(F.count("*").alias("n"))


@R.add("SELECT count(*) AS n FROM region")
def temp_table_roundtrip(spark, sf):
    model = Table(TableId(DatasetRef(ProjectId("quill-tests"), "upkeep"), "model"), schema=Schema.of(Field("r_name", Type.STRING)))
    Catalog(spark).create_dataset(model.id.dataset)
    with temporary_table(spark, model, model.id.dataset) as own:
        write(read(spark, sf, "region").select("r_name"), own, Disposition.EMPTY)
        n = own.frame(spark).count()
    return spark.createDataFrame([(n,)], "n long")


@R.add(_COUNTS)
def dataset_copy_roundtrip(spark, sf):
    source = _loaded(spark, sf, "copied", key="copysource")
    target = DatasetRef(ProjectId("quill-tests"), "copytarget")
    Catalog(spark).create_dataset(target)
    spark.sql(f"DROP TABLE IF EXISTS {TableId(target, 'copied').sql}")
    _clear(spark, target, "copied")
    status = copy_dataset(spark, source.id.dataset, target)
    if status.state != "SUCCEEDED":
        raise RuntimeError(status.error)
    return spark.table(TableId(target, "copied").sql).groupBy("d").agg(F.count("*").alias("n"))


@R.add(f"SELECT o_orderstatus, {total('o_totalprice')} AS amount FROM orders GROUP BY 1")
def materialized_view_refresh(spark, sf):
    catalog, dataset = Catalog(spark), DatasetRef(ProjectId("quill-tests"), "upkeep")
    catalog.create_dataset(dataset)
    orders = view(read(spark, sf, "orders"), "quill_orders")
    mv = MaterializedView(TableId(dataset, "amounts"), schema=Schema.of(Field("o_orderstatus", Type.STRING), Field("amount", Type.FLOAT64)), query=frag(f"SELECT o_orderstatus, {total('o_totalprice')} AS amount FROM {{t}} GROUP BY 1", t=orders))
    for name in ("amounts", "amounts__refreshing"):
        spark.sql(f"DROP TABLE IF EXISTS {TableId(dataset, name).sql}")
        _clear(spark, dataset, name)
    catalog.refresh(mv, force=True)
    return mv.frame(spark)


@R.add("SELECT unnest(['base', 'other']) AS source, unnest(['2024-01-03', 'all']) AS part")
def lineage_report(spark, sf):
    """What a partition of a view reads: its day goes on to what the view reads whole by day."""
    def table(name, scheme):
        return Table(TableId.of("my-project", "ds", name), scheme, Schema(_FIELDS))

    base, other = table("base", Day("d")), table("other", IntRange("event_id"))
    v = View(TableId.of("my-project", "ds", "joined"), Day("d"), query=frag("SELECT * FROM {a} JOIN {b} USING (event_id)", a=base.unpartitioned, b=other.whole_table))
    found = frag("SELECT * FROM {v}", v=v.partition(_DAY)).partitions()
    return spark.createDataFrame([(p.table.id.table, str(getattr(p, "value", "all"))) for p in found], "source string, part string")


@R.add("SELECT unnest(['append', 'create', 'reorder', 'repartition', 'same', 'view']) AS change, unnest(['Update', 'Create', 'IllegalExtension', 'UnsupportedPartitioning', 'Noop', 'Illegal']) AS operation")
def update_plan_report(spark, sf):
    id = TableId.of("my-project", "ds", "planned")
    old, more = Table(id, schema=Schema(_FIELDS)), Field("more", Type.STRING)
    wanted = {
        "append": Table(id, schema=old.schema.extend([more])), "reorder": Table(id, schema=Schema(_FIELDS[::-1])), "same": old,
        "repartition": Table(id, Day("d"), old.schema), "view": View(id, schema=old.schema, query=frag("SELECT 1")),
    }
    rows = [(k, type(deploy.plan(w, old)).__name__) for k, w in wanted.items()]
    return spark.createDataFrame([*rows, ("create", type(deploy.plan(old, None)).__name__)], "change string, operation string")


@R.add("SELECT unnest(['Expected field `b`, got field `a`', 'Expected field `a`, got field `b`', 'At root: expected 3 fields, got 2']) AS violation")
def conformance_report(spark, sf):
    a, b = Field("a", Type.INT64), Field("b", Type.INT64)
    found = conforms.only_types(Schema.of(a, b), Schema.of(b, a)) + conforms.field_counts(Schema.of(a, b), Schema.of(a, b, Field("c", Type.DATE)))
    return spark.createDataFrame([(x,) for x in found], "violation string")


@R.add("SELECT DATE '2024-01-03' AS d, 'event_type' AS event_type, CAST(0 AS BIGINT) AS event_id")
def static_example_rows(spark, sf):
    """A query over one made-up row of each table it reads."""
    table = Table(TableId.of("my-project", "ds", "events"), Day("d"), Schema(_FIELDS))
    with example_tables(spark, frag("SELECT d, event_type, event_id FROM {p}", p=table.partition(_DAY))) as sql:
        rows = spark.sql(sql).collect()
    return spark.createDataFrame(rows, "d date, event_type string, event_id long")


@R.add("SELECT unnest(['k', 'n', 'tags']) AS name, unnest(['STRING', 'INT64', 'STRING']) AS kind, unnest(['NULLABLE', 'NULLABLE', 'REPEATED']) AS mode")
def dry_run_schema(spark, sf):
    view(read(spark, sf, "events"), "quill_events_all")
    found = analysis.output_fields(spark, "SELECT event_type AS k, count(*) AS n, array(event_type) AS tags FROM quill_events_all GROUP BY 1")
    return spark.createDataFrame([(f.name, f.type.value, f.mode.value) for f in found], "name string, kind string, mode string")


@R.add("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, CAST(r_regionkey * 2 AS BIGINT) AS twice FROM region")
def udf_python_body(spark, sf):
    double = Udf("quill_py_double", (Param("x", _LONG),), lambda x: None if x is None else x * 2, _LONG)
    t = view(read(spark, sf, "region").withColumn("r_regionkey", F.col("r_regionkey").cast("long")), "quill_region")
    return frag("SELECT r_regionkey, {x} AS twice FROM {t}", x=double(frag("r_regionkey")), t=t).run(spark)


@R.add("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def tvf_persistent(spark, sf):
    view(read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")), "quill_nations")
    text = TypeOf(Mode.NULLABLE, Type.STRING)
    f = Tvf("quill_nations_of", (Param("region", text),), frag("SELECT n_name, r_name FROM quill_nations WHERE r_name = region"), Schema.of(Field("n_name", Type.STRING), Field("r_name", Type.STRING)), DatasetRef(ProjectId("quill-tests"), "upkeep"))
    return frag("SELECT * FROM {f}", f=f("ASIA")).run(spark)


@R.add(_COUNTS)
def job_into_partitions(spark, sf):
    """A named job for each day; the last run of a day holds."""
    events = view(events_by_day(spark, sf).select("event_id", "event_type", "d"), "quill_events_day", Day("d"))
    table, client = _fresh(spark, "jobs", Day("d"), *_FIELDS, key="upkeep"), Client(spark)
    filled = FilledTable("fill_jobs", table, lambda day: frag("SELECT event_id, event_type, d FROM {p}", p=events.partition(day)))
    days = days_of(spark, sf)
    for day in [*days, days[0]]:
        fill = filled.with_date(day)
        client.submit(JobId(fill.job), fill.query, fill.destination, Disposition.TRUNCATE)
    return table.frame(spark).groupBy("d").agg(F.count("*").alias("n"))


@R.add("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_daily_counts(spark, sf):
    """Beyond batch: windows of event time over a stream of the files."""
    schema = read(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = windowed_counts(stream, "ts", "1 hour", "1 day", "event_type").writeStream.format("memory").queryName("quill_stream_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("quill_stream_counts").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


QUERIES, ORACLES = R.queries, R.oracles
