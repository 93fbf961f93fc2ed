"""What the queries share: the tables as session views, and registration with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.ids import TableId
from quillspark.partition import NotPartitioned, Scheme
from quillspark.tables import TableRef


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(df: DataFrame, name: str, scheme: Scheme | None = None) -> TableRef:
    """A frame as a session view that fragments can name."""
    df.createOrReplaceTempView(name)
    return TableRef(TableId.local(name), scheme or NotPartitioned())


def orders_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))


def events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("d", F.col("ts").cast("date"))


def days_of(spark: SparkSession, sf_dir: str) -> list:
    """The days that there are events of."""
    return sorted(r[0] for r in events_by_day(spark, sf_dir).select("d").distinct().collect())


def total(column: str) -> str:
    """An exact sum of amounts, the same in any order."""
    return f"CAST(SUM(CAST({column} AS DECIMAL(18, 2))) AS DOUBLE)"
