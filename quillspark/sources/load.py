"""Writing rows and queries into tables, by partition and disposition."""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import DuplicateKeys, QuillError, RequiredNull, SchemaMismatch
from quillspark.functions.hashing import hashed
from quillspark.ids import TableId, quote
from quillspark.literals import literal
from quillspark.operators.merge import TWICE, in_partitions, upsert
from quillspark.operators.scan import scan_partition
from quillspark.partition import IntRange, PartitionId, Sharded, Timed
from quillspark.tables import Fill, Table
from quillspark.types import Mode, Schema


class Disposition(Enum):
    TRUNCATE = "TRUNCATE"
    APPEND = "APPEND"
    EMPTY = "EMPTY"


def align(df: DataFrame, schema: Schema) -> DataFrame:
    """Columns in the schema's order and types. A column too many or one that is required and missing is an error."""
    wanted = schema.to_spark()
    extra = [c for c in df.columns if c not in schema.names]
    missing = [f.name for f in schema if f.name not in df.columns and f.mode is Mode.REQUIRED]
    if extra or missing:
        raise SchemaMismatch([f"no column `{c}` in the table" for c in extra] + [f"required column `{c}` is missing" for c in missing])
    absent = {f.name: F.array().cast(s.dataType) if f.mode is Mode.REPEATED else F.lit(None).cast(s.dataType) for f, s in zip(schema, wanted, strict=True)}
    cols = [(F.col(quote(f.name)).cast(f.dataType) if f.name in df.columns else absent[f.name]).alias(f.name) for f in wanted]
    return df.select(*cols)


_MARK = "quillspark:"


def _point(partition: PartitionId):
    """The value that the partition column holds."""
    return getattr(partition.scheme, "point", lambda v: v)(partition.value)


def guarded(df: DataFrame, schema: Schema, *partitions: PartitionId) -> DataFrame:
    """``df`` that fails while it is written, in the same pass, on a null in a required column or a row of no given partition."""

    def stop(kind: str, what: str) -> Column:
        return F.raise_error(F.lit(f"{_MARK}{kind}:{what};"))

    cols = []
    for f in schema:
        c = F.col(quote(f.name))
        if f.mode is Mode.REQUIRED:
            c = F.when(c.isNull(), stop("null", f.name)).otherwise(c)
        cols.append(c.alias(f.name))
    if partitions:
        # as a filter it holds even where the partition column is not written
        first = partitions[0]
        inside = first.scheme.predicate(first.value) if len(partitions) == 1 else in_partitions(first.scheme.column, [_point(p) for p in partitions])
        df = df.where(F.when(F.coalesce(inside, F.lit(False)), F.lit(True)).otherwise(stop("outside", str(first.table_id)).cast("boolean")))
    return df.select(*cols)


def _own_name(id: TableId, what: str) -> str:
    """A name beside the table's, of this call alone."""
    return id.with_table(f"{id.table}__{what}_{uuid.uuid4().hex}").sql


@contextmanager
def staged(df: DataFrame, id: TableId, what: str):
    """``df`` written to a table of its own beside ``id``, which is dropped at the end."""
    spark, name = df.sparkSession, _own_name(id, what)
    try:
        df.write.saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextmanager
def _dynamic(spark: SparkSession):
    """Overwriting replaces only the partitions that are written."""
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _replace(df: DataFrame, table: Table, stale: list) -> None:
    """Overwrite the partitions that ``df``, at rest, has rows of, and then drop those of ``stale`` that it has none of."""
    spark, column = df.sparkSession, table.partitioning.column
    df = df.select(*[quote(c) for c in spark.table(table.id.sql).columns])
    if column is None:
        df.write.insertInto(table.id.sql, overwrite=True)
        return
    with _dynamic(spark):
        df.write.insertInto(table.id.sql, overwrite=True)
    have = {r[0] for r in df.select(quote(column)).distinct().collect()}
    for v in [v for v in stale if v not in have]:
        spark.sql(f"ALTER TABLE {table.id.sql} DROP IF EXISTS PARTITION ({quote(column)} = {'NULL' if v is None else literal(v)})")


@contextmanager
def _told():
    """What a guard says, as an error of ours."""
    try:
        yield
    except Exception as e:
        if twice := re.search(rf"{TWICE}(.*)", str(e)):
            raise DuplicateKeys(twice[1]) from e
        found = re.search(rf"{_MARK}(null|outside):([^;]*);", str(e))
        if found is None:
            raise
        if found[1] == "null":
            raise RequiredNull(f"nulls in {found[2]}") from e
        raise QuillError(f"rows outside of the partition {found[2]}") from e


def write(df: DataFrame, destination: Table | PartitionId, disposition: Disposition = Disposition.EMPTY) -> None:
    """Write a frame to a table or to one partition of it.

    TRUNCATE replaces what the destination holds, APPEND adds, EMPTY demands that it is empty.
    """
    spark = df.sparkSession
    partition = destination if isinstance(destination, PartitionId) else None
    table: Table = partition.table if partition else destination
    sharded = partition is not None and isinstance(partition.scheme, Sharded)
    df = guarded(align(df, table.schema), table.schema, *([partition] if partition and not sharded else []))
    with _told():
        if sharded:
            _write_whole(df, partition.table_id, disposition, spark)
        else:
            _write(df, table, partition, disposition, spark)


def _write(df: DataFrame, table: Table, partition: PartitionId | None, disposition: Disposition, spark: SparkSession) -> None:
    if disposition is Disposition.EMPTY:
        there = table.frame(spark)
        if (there.where(partition.scheme.predicate(partition.value)) if partition else there).take(1):
            raise QuillError(f"{partition.table_id if partition else table.id} is not empty")
    # in the catalog's order, where partition columns come last
    df = df.select(*[quote(c) for c in spark.table(table.id.sql).columns])
    if disposition is not Disposition.TRUNCATE:
        df.write.insertInto(table.id.sql)
    elif partition is None:
        # Spark empties a table before it writes; what fails must fail before that
        with staged(df, table.id, "writing") as rows:
            rows.write.insertInto(table.id.sql, overwrite=True)
    elif isinstance(partition.scheme, IntRange) and partition.scheme.window(partition.value) != (partition.value, partition.value):
        # a window of several values: those that the new rows lack go too
        column = quote(partition.scheme.column)
        stale = [v for (v,) in table.frame(spark).where(partition.scheme.predicate(partition.value)).select(column).distinct().collect()]
        with staged(df, table.id, "writing") as rows:
            _replace(rows, table, stale)
    else:
        _overwrite(df, table, [partition])


def _overwrite(df: DataFrame, table: Table, partitions: list[PartitionId]) -> None:
    """Replace ``partitions`` when all of ``df``, which has the catalog's columns, is written."""
    # a dynamic overwrite replaces the partitions that it has rows of; those without rows are dropped
    spark, column = df.sparkSession, quote(table.partitioning.column)
    written = Observation(f"written-{uuid.uuid4().hex}")
    with _dynamic(spark):
        df.observe(written, F.collect_set(F.col(column).cast("string")).alias("points")).write.insertInto(table.id.sql, overwrite=True)
    points = [literal(_point(p)) for p in partitions]
    names = spark.range(1).select(F.array(*[F.expr(p).cast(df.schema[table.partitioning.column].dataType).cast("string") for p in points])).first()[0]
    have = set(written.get["points"])
    for point, name in zip(points, names, strict=True):
        if name not in have:
            spark.sql(f"ALTER TABLE {table.id.sql} DROP IF EXISTS PARTITION ({column} = {point})")


def _in_one_write(partitions: list[PartitionId]) -> Table:
    """Their table, where one dynamic overwrite can replace them all."""
    table, scheme = partitions[0].table, partitions[0].scheme
    if any(p.table.id != table.id for p in partitions):
        raise TypeError("partitions of several tables cannot be written together")
    if not isinstance(scheme, (Timed, IntRange)) or isinstance(scheme, IntRange) and any(scheme.window(p.value) != (p.value, p.value) for p in partitions):
        raise TypeError(f"partitions of {table.id} are written one by one")
    return table


def write_partitions(df: DataFrame, partitions: list[PartitionId]) -> None:
    """Replace some partitions of one table by the rows of ``df`` in one write, however many they are.

    A row of another partition makes it fail before anything is replaced. A partition
    without rows ends empty. Shards and windows of several values are left to ``write``.
    """
    if not partitions:
        return
    table = _in_one_write(partitions)
    rows = guarded(align(df, table.schema), table.schema, *partitions)
    with _told():
        _overwrite(rows.select(*[quote(c) for c in df.sparkSession.table(table.id.sql).columns]), table, partitions)


def _write_whole(df: DataFrame, id: TableId, disposition: Disposition, spark: SparkSession) -> None:
    name = id.sql
    if disposition is Disposition.EMPTY and spark.catalog.tableExists(name) and spark.table(name).take(1):
        raise QuillError(f"{name} is not empty")
    if spark.catalog.tableExists(name) and disposition is Disposition.TRUNCATE:
        with staged(df, id, "writing") as rows:
            rows.write.insertInto(name, overwrite=True)
    elif spark.catalog.tableExists(name):
        df.write.insertInto(name)
    else:
        df.write.saveAsTable(name)


#: Python rows that are held here at once.
ROWS = 50_000


def load_rows(spark: SparkSession, destination: Table | PartitionId, rows: Iterable[dict], disposition: Disposition = Disposition.APPEND) -> int | None:
    """Load Python rows; fields that are missing are null. None where there are no rows at all.

    More than ``ROWS`` are put into a staging table part by part, and go to the destination in one write.
    """
    table = destination.table if isinstance(destination, PartitionId) else destination
    schema = table.schema.to_spark()

    def frame(part) -> DataFrame:
        # rows go in as JSON lines
        lines = spark.createDataFrame([(json.dumps({k: v for k, v in r.items() if v is not None}, default=str),) for r in part], "line string")
        return lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")

    parts = itertools.batched(rows, ROWS)
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return None
    if second is None:
        write(frame(first), destination, disposition)
        return len(first)
    n, name = len(first), _own_name(table.id, "loading")
    try:
        frame(first).write.saveAsTable(name)
        for part in itertools.chain([second], parts):
            frame(part).write.insertInto(name)
            n += len(part)
        write(spark.table(name), destination, disposition)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return n


def load_json(spark: SparkSession, destination: Table | PartitionId, path: str, disposition: Disposition = Disposition.APPEND) -> None:
    """Load newline-delimited JSON, compressed or not."""
    table = destination.table if isinstance(destination, PartitionId) else destination
    write(spark.read.schema(table.schema.to_spark()).option("mode", "FAILFAST").json(path), destination, disposition)


def load_hashed(df: DataFrame, table: Table, key: str) -> None:
    """Append rows, each in the partition that the hash of ``key`` gives."""
    if not isinstance(table.partitioning, IntRange):
        raise TypeError(f"{table.id} is not partitioned by a range")
    write(df.withColumn(table.partitioning.column, hashed(F.col(key), table.partitioning)), table, Disposition.APPEND)


def run_fill(spark: SparkSession, fill: Fill, disposition: Disposition = Disposition.TRUNCATE) -> None:
    """Make one partition from its query."""
    write(fill.query.run(spark), fill.destination, disposition)


def run_fills_together(spark: SparkSession, fills: list[Fill]) -> None:
    """Make several partitions of one table, each from its query, in one write: a backfill is one job, and all of it or none takes effect."""
    if not fills:
        return
    table = _in_one_write([f.destination for f in fills])
    own = [guarded(align(f.query.run(spark), table.schema), table.schema, f.destination) for f in fills]
    write_partitions(reduce(DataFrame.unionByName, own), [f.destination for f in fills])


def merge_into(source: DataFrame | PartitionId, target: Table | PartitionId, keys: list[str]) -> None:
    """Upsert into a table in the catalog, which may not be the source's own.

    The source may be a partition of another table, and the target one partition, which
    then must hold all rows of the source; both need a table with a schema. The result is
    kept in a staging table first, as Spark cannot overwrite what it reads; then only the
    partitions that the source has are replaced.
    """
    from pyspark.sql import SparkSession

    partition = target if isinstance(target, PartitionId) else None
    table = partition.table if partition else target
    own = source.table if isinstance(source, PartitionId) else None
    if any(t is not None and not isinstance(t, Table) for t in (table, own)):
        raise TypeError("only tables with a schema can be merged")
    if isinstance(source, PartitionId):
        source = scan_partition(SparkSession.getActiveSession(), source)
    rows = align(source, table.schema)
    if partition:
        rows = guarded(rows, table.schema, partition)
    spark = source.sparkSession
    with _told():
        merged = upsert(rows, table.frame(spark), keys, table.partitioning, prune=True)
        with staged(merged, table.id, "merging") as result:
            _replace(result, table, [])


def _rewrite(table: Table, condition: Column, change) -> None:
    """Rewrite the partitions that have rows for which ``condition`` holds."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    frame, column = table.frame(spark), table.partitioning.column
    touched = [None]
    if column:
        touched = [r[0] for r in frame.where(condition).select(quote(column)).distinct().collect()]
        frame = frame.where(in_partitions(column, touched)) if touched else frame.limit(0)
    if touched:
        with staged(change(frame, F.coalesce(condition, F.lit(False))), table.id, "rewriting") as rows:
            _replace(rows, table, touched if column else [])


def delete_where(table: Table, condition: Column) -> None:
    """Remove the rows for which ``condition`` holds, by writing the partitions anew that have any."""
    _rewrite(table, condition, lambda rows, hit: rows.where(~hit))


def update_where(table: Table, condition: Column, values: dict[str, Column]) -> None:
    """Set columns, though not the partition column, in the rows for which ``condition`` holds."""
    if table.partitioning.column in values:
        raise QuillError(f"{table.partitioning.column} says which partition a row is in and cannot be set")

    def change(rows: DataFrame, hit: Column) -> DataFrame:
        new = {c: F.when(hit, v).otherwise(F.col(quote(c))) for c, v in values.items()}
        return guarded(align(rows.withColumns(new), table.schema), table.schema)

    with _told():
        _rewrite(table, condition, change)
