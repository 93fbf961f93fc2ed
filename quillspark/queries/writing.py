"""Merges, hashed loads, loads, exports and fills."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillspark.fragment import frag
from quillspark.functions.hashing import hashed
from quillspark.ids import DatasetRef, ProjectId, TableId
from quillspark.operators.merge import upsert
from quillspark.partition import Day, IntRange
from quillspark.plans.catalog import Catalog
from quillspark.queries.base import Registry, days_of, events_by_day, read, total, view
from quillspark.sources.extract import Csv, Format, JsonLines, Parquet, extract, read_back
from quillspark.sources.load import Disposition, load_rows, merge_into, run_fills_together, write, write_partitions
from quillspark.tables import FilledTable, Table
from quillspark.types import Field, Mode, Schema, Type

R = Registry()
_COLUMNS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
_SOURCE = "SELECT c_custkey + 75 AS c_custkey, 'new ' || c_name AS c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer"


def _customers(spark, sf):
    target = read(spark, sf, "customer").select(*_COLUMNS.split(", "))
    source = target.select((F.col("c_custkey") + 75).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"), "c_nationkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), "c_mktsegment")
    return source, target


@R.add(f"""WITH s AS ({_SOURCE}) SELECT {_COLUMNS} FROM s UNION ALL
    SELECT {_COLUMNS} FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s)""")
def merge_upsert_single_key(spark, sf):
    source, target = _customers(spark, sf)
    return upsert(source, target, ["c_custkey"])


# every 50th key is null, and the keys of the source are shifted
_KEYED = "SELECT CASE WHEN (c_custkey + {shift}) % 50 = 0 THEN NULL ELSE c_custkey + {shift} END AS k1, CASE WHEN (c_custkey + {shift}) % 50 = 0 THEN c_custkey + {shift} ELSE (c_custkey + {shift}) % 25 END AS k2, '{word} ' || c_name AS v FROM {table}"


@R.add(f"""WITH t AS ({_KEYED.format(word="old", shift=0, table="customer")}), s AS ({_KEYED.format(word="new", shift=75, table="customer")})
    SELECT coalesce(s.k1, t.k1) AS k1, coalesce(s.k2, t.k2) AS k2, CASE WHEN s.v IS NOT NULL THEN s.v ELSE t.v END AS v
    FROM t FULL JOIN s ON t.k1 IS NOT DISTINCT FROM s.k1 AND t.k2 IS NOT DISTINCT FROM s.k2""")
def merge_upsert_composite_nullable(spark, sf):
    view(read(spark, sf, "customer"), "quill_customer")

    side = lambda word, shift: spark.sql(_KEYED.format(word=word, shift=shift, table="quill_customer"))
    return upsert(side("new", 75), side("old", 0), ["k1", "k2"])


@R.add("""SELECT event_id, CAST(ts AS DATE) AS d, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE event_type END AS event_type FROM events
    WHERE CAST(ts AS DATE) IN (DATE '2024-01-03', DATE '2024-01-07')""")
def merge_partition_pruned(spark, sf):
    target = events_by_day(spark, sf).select("event_id", "d", "event_type")
    source = target.where((F.col("event_id") % 3 == 0) & F.col("d").isin(dt.date(2024, 1, 3), dt.date(2024, 1, 7))).withColumn("event_type", F.lit("new"))
    return upsert(source, target, ["event_id"], Day("d"), prune=True)


_HASH = "CAST('0x' || substring(sha256(coalesce(c_name, '')), 1, 14) AS BIGINT) % 4000"


@R.add(f"SELECT c_custkey, {_HASH} AS part FROM customer")
def hash_partition_number(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", hashed(F.col("c_name"), IntRange("part")).alias("part"))


@R.add(f"SELECT {_HASH} AS part, count(*) AS n FROM customer GROUP BY 1")
def hash_partition_histogram(spark, sf):
    return read(spark, sf, "customer").groupBy(hashed(F.col("c_name"), IntRange("part")).alias("part")).agg(F.count("*").alias("n"))


# with tables in the catalog


def _fresh(spark, name: str, scheme, *fields: Field, key: str = "work") -> Table:
    """A new, empty table of this query's own."""
    catalog, dataset = Catalog(spark), DatasetRef(ProjectId("quill-tests"), key)
    catalog.create_dataset(dataset)
    table = Table(TableId(dataset, name), scheme, Schema.of(*fields))
    spark.sql(f"DROP TABLE IF EXISTS {table.id.sql}")
    _clear(spark, dataset, name)
    catalog.create_table(table)
    return table


def _clear(spark, dataset: DatasetRef, name: str) -> None:
    """Files that an earlier session left where the table is to be."""
    where = spark.sql(f"DESCRIBE DATABASE `{dataset.database}`").where("info_name = 'Location'").first()[1]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@R.add("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def load_roundtrip_partition(spark, sf):
    table = _fresh(spark, "loaded", Day("d"), Field("event_id", Type.INT64, Mode.REQUIRED), Field("event_type", Type.STRING), Field("d", Type.DATE))
    events = events_by_day(spark, sf).select("event_id", "event_type", "d")
    days = days_of(spark, sf)
    write_partitions(events, [table.partition(day) for day in days])
    for day in days[:2]:  # the second write of a day replaces the first
        write(events.where(F.col("d") == F.lit(day)), table.partition(day), Disposition.TRUNCATE)
    return table.frame(spark).groupBy("event_type").agg(F.count("*").alias("n"))


@R.add("SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region UNION ALL SELECT 100, NULL")
def load_rows_roundtrip(spark, sf):
    table = _fresh(spark, "rows_loaded", IntRange("k", 0, 4000, 1), Field("name", Type.STRING), Field("k", Type.INT64))
    rows = [{"k": r[0], "name": r[1]} for r in read(spark, sf, "region").collect()]
    load_rows(spark, table, [*rows, {"k": 100, "name": None}])
    return table.frame(spark).select("k", "name")


def _extract(spark, sf, fmt: Format, compression: str):
    df = read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    path = f"{where}/quill_extract_{fmt.name}"
    extract(df, path, fmt, compression, mode="overwrite")
    return read_back(spark, path, fmt, df.schema).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.expr(total("c_acctbal")).alias("balance"))


_EXTRACT = f"SELECT c_mktsegment, count(*) AS n, {total('c_acctbal')} AS balance FROM customer GROUP BY 1"


@R.add(_EXTRACT)
def extract_roundtrip_csv(spark, sf):
    return _extract(spark, sf, Csv(delimiter=";"), "gzip")


@R.add(_EXTRACT)
def extract_roundtrip_json(spark, sf):
    return _extract(spark, sf, JsonLines(), "gzip")


@R.add(_EXTRACT)
def extract_roundtrip_parquet(spark, sf):
    return _extract(spark, sf, Parquet(), "zstd")


@R.add("SELECT event_type, count(*) AS n, CAST(ts AS DATE) AS d FROM events GROUP BY 1, 3")
def fill_daily_summary(spark, sf):
    events = view(events_by_day(spark, sf), "quill_events_day", Day("d"))
    table = _fresh(spark, "daily", Day("d"), Field("event_type", Type.STRING), Field("n", Type.INT64), Field("d", Type.DATE))
    filled = FilledTable("daily", table, lambda day: frag("SELECT event_type, count(*) AS n, d FROM {p} GROUP BY event_type, d", p=events.partition(day)))
    days = days_of(spark, sf)
    run_fills_together(spark, [filled.with_date(day) for day in days])
    return frag("SELECT event_type, n, d FROM {fills}", fills=[filled.with_date(d) for d in days]).run(spark)


@R.add("""SELECT event_id, CASE WHEN event_id % 4 = 0 AND CAST(ts AS DATE) = DATE '2024-01-06' THEN 'new' ELSE event_type END AS event_type, CAST(ts AS DATE) AS d
    FROM events""")
def merge_into_table(spark, sf):
    table = _fresh(spark, "merged", Day("d"), Field("event_id", Type.INT64), Field("event_type", Type.STRING), Field("d", Type.DATE))
    events = events_by_day(spark, sf).select("event_id", "event_type", "d")
    write(events, table, Disposition.EMPTY)
    new = events.where((F.col("d") == F.lit(dt.date(2024, 1, 6))) & (F.col("event_id") % 4 == 0)).withColumn("event_type", F.lit("new"))
    merge_into(new, table, ["event_id"])
    return table.frame(spark)


QUERIES, ORACLES = R.queries, R.oracles
