"""Partitions and tables as frames. Filters are on the partition column, so Spark prunes by them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.fragment import by_table
from quillspark.partition import IntRange, PartitionId, Scheme, Sharded, Timed
from quillspark.tables import TableLike


def restrict(df: DataFrame, scheme: Scheme, value, bucket: bool = False) -> DataFrame:
    """The rows of one partition. ``bucket``: the column holds instants rather than the partition's own value; a range of them is read."""
    scheme.check(value)
    if bucket and isinstance(scheme, Timed):
        scheme = replace(scheme, raw=True)
    return df.where(scheme.predicate(value))


def scan_partition(spark: SparkSession, partition: PartitionId) -> DataFrame:
    if isinstance(partition.scheme, Sharded):
        return spark.table(partition.table_id.sql)
    return restrict(partition.table.frame(spark), partition.scheme, partition.value)


def scan_partitions(spark: SparkSession, partitions: Iterable[PartitionId], suffix: str | None = None) -> DataFrame:
    """Partitions of one or more tables: one scan for a table, and a union by position.

    ``suffix`` names a column for the day of each shard, as a wildcard over shards gives it.
    """
    frames = []
    for table, own in by_table(partitions):
        scheme = table.partitioning
        if isinstance(scheme, Sharded):
            for p in own:
                df = spark.table(p.table_id.sql)
                frames.append(df.withColumn(suffix, F.lit(scheme.suffix(p.value))) if suffix else df)
        elif scheme.column is None:
            frames.append(table.frame(spark))
        elif isinstance(scheme, IntRange) or isinstance(scheme, Timed) and scheme.raw:
            frames.append(table.frame(spark).where(reduce(lambda a, b: a | b, [scheme.predicate(p.value) for p in own])))
        else:
            frames.append(table.frame(spark).where(F.col(scheme.column).isin([scheme.point(p.value) for p in own])))
    return reduce(DataFrame.union, frames)


def scan_tables(spark: SparkSession, tables: Iterable[TableLike]) -> DataFrame:
    """All rows of some tables, by position."""
    return reduce(DataFrame.union, [t.frame(spark) for t in tables])


def shards(spark: SparkSession, table: TableLike) -> list[PartitionId]:
    """The shards that the catalog has, newest first."""
    name = table.id.spark_name
    where = f" IN {table.id.sql.rpartition('.')[0]}" if table.id.dataset else ""
    names = [r["tableName"] for r in spark.sql(f"SHOW TABLES{where} LIKE '{name}_*'").collect()]
    days = sorted((n.removeprefix(f"{name}_") for n in names if n.removeprefix(f"{name}_").isdigit() and len(n) == len(name) + 9), reverse=True)
    return [table.partition(table.partitioning.parse(d)) for d in days]



