"""Which partitions a table has.

From files alone where the table is partitioned in Spark's catalog; from the data for
views and frames. Newest first. The null partition is never listed.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.literals import YearMonth
from quillspark.operators.scan import shards
from quillspark.partition import Day, Hour, IntRange, Month, PartitionId, Scheme, Sharded, Start, newest_first
from quillspark.tables import TableLike, View


@dataclass(frozen=True)
class Metadata:
    """What is known of a partition; None where it is not."""

    created: dt.datetime | None = None
    modified: dt.datetime | None = None
    rows: int | None = None
    bytes: int | None = None


def distinct_partitions(df: DataFrame, scheme: Scheme, start: Start = Start()) -> DataFrame:
    """Values of the partition column, newest first."""
    column = scheme.column
    return df.where(start.predicate(scheme) & F.col(column).isNotNull()).select(column).distinct().orderBy(F.desc(column))


def row_counts(df: DataFrame, scheme: Scheme, start: Start = Start()) -> DataFrame:
    """(partition column, n) in ascending order."""
    column = scheme.column
    return df.where(start.predicate(scheme) & F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def _value(scheme: Scheme, raw):
    """What names the partition whose column holds ``raw``, a value or the text in a path."""
    if isinstance(scheme, IntRange):
        return int(raw)
    if isinstance(raw, str):
        raw = dt.datetime.fromisoformat(raw) if isinstance(scheme, Hour) else dt.date.fromisoformat(raw[:10])
    if isinstance(scheme, Month):
        return YearMonth(raw.year, raw.month)
    if isinstance(scheme, Day) and isinstance(raw, dt.datetime):
        return raw.date()
    return raw


def _files(spark: SparkSession, paths: list[str]) -> dict[str, Metadata]:
    """Age and size of the files in each of some folders, by the folder; Spark lists them and adds up, and opens none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (at := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(at)]
    if not there:
        return {}
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there).select("path", "modificationTime", "length")
    own = {jvm.org.apache.hadoop.fs.Path(p).toUri().getPath().rstrip("/"): p for p in there}
    depth = len(next(iter(own)).split("/"))
    # the path without its scheme, as deep as the folders are
    plain = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", "")
    folder = F.array_join(F.slice(F.split(plain, "/"), 1, depth), "/")
    ms = F.unix_millis("modificationTime")
    found = rows.groupBy(folder.alias("f")).agg(F.min(ms).alias("a"), F.max(ms).alias("b"), F.sum("length").alias("n")).collect()
    at = lambda x: dt.datetime.fromtimestamp(x / 1000, dt.UTC)
    return {own[r["f"]]: Metadata(at(r["a"]), at(r["b"]), None, r["n"]) for r in found if r["f"] in own}


def _location(spark: SparkSession, table: TableLike) -> str | None:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table.id.sql}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"] if rows else None


def table_metadata(spark: SparkSession, table: TableLike, with_rows: bool = False) -> Metadata:
    """Of the table as a whole."""
    location = _location(spark, table)
    found = _files(spark, [location]).get(location, Metadata(bytes=0)) if location else Metadata()
    rows = spark.table(table.id.sql).count() if with_rows else None
    return Metadata(found.created, found.modified, rows, found.bytes)


def list_partitions(spark: SparkSession, table: TableLike, start: Start = Start(), with_rows: bool = False) -> list[tuple[PartitionId, Metadata]]:
    """Partitions with what is known of them. Rows are counted only on request."""
    scheme = table.partitioning
    own = start.for_scheme(scheme)
    if isinstance(scheme, Sharded):
        out = []
        for p in shards(spark, table):
            if own.admits(p.value):
                out.append((p, table_metadata(spark, TableLike(p.table_id), with_rows)))
        return out
    if scheme.column is None:
        return [(PartitionId(table, None), table_metadata(spark, table, with_rows))]
    listed: dict = {}
    location = None if isinstance(table, View) else _location(spark, table)
    if location and any(f.name == scheme.column for f in _partition_columns(spark, table)):
        for row in spark.sql(f"SHOW PARTITIONS {table.id.sql}").collect():
            name, _, raw = row[0].partition("=")
            if name == scheme.column and raw != "__HIVE_DEFAULT_PARTITION__" and own.admits(value := _value(scheme, unquote(raw))):
                listed[value] = f"{location.rstrip('/')}/{row[0]}"
        # only the folders within the bound are looked into
        files = _files(spark, list(listed.values()))
        listed = {v: files.get(p, Metadata()) for v, p in listed.items()}
    else:
        for row in distinct_partitions(spark.table(table.id.sql), scheme, own).collect():
            listed[_value(scheme, row[0])] = Metadata()
    counts = {_value(scheme, r[0]): r["n"] for r in row_counts(spark.table(table.id.sql), scheme, own).collect()} if with_rows else {}
    ids = newest_first([PartitionId(table, v) for v in listed if own.admits(v)])
    if isinstance(scheme, IntRange):
        ids.sort(key=lambda p: -p.value)
    return [(p, Metadata(listed[p.value].created, listed[p.value].modified, counts.get(p.value, 0) if with_rows else None, listed[p.value].bytes)) for p in ids]


def _partition_columns(spark: SparkSession, table: TableLike):
    return [c for c in spark.catalog.listColumns(table.id.sql) if c.isPartition]


def expire_partitions(spark: SparkSession, table, today: dt.date) -> list[PartitionId]:
    """Drop partitions older than the table's option says; returns them."""
    days = table.options.partition_expiration_days
    if days is None or not isinstance(table.partitioning, (Day, Hour, Month)):
        return []
    limit = today - dt.timedelta(days=days)
    as_day = lambda v: v.first_day if isinstance(v, YearMonth) else v.date() if isinstance(v, dt.datetime) else v
    old = [p for p, _ in list_partitions(spark, table) if as_day(p.value) < limit]
    from quillspark.ids import quote
    from quillspark.literals import literal

    for p in old:
        spark.sql(f"ALTER TABLE {table.id.sql} DROP IF EXISTS PARTITION ({quote(p.scheme.column)} = {literal(p.scheme.point(p.value))})")
    return old
