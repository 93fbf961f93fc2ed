"""Tables, views and materialised views: what they are called, hold, and how they are split."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from quillspark.ids import Ident, TableId, TableLabels
from quillspark.partition import Ignored, NotPartitioned, PartitionId, Scheme
from quillspark.types import Schema

if TYPE_CHECKING:
    from quillspark.fragment import Frag


@dataclass(frozen=True)
class TableOptions:
    #: Reading without a filter on the partition column is refused.
    partition_filter_required: bool = False
    #: Days after which a partition may be dropped.
    partition_expiration_days: int | None = None


@dataclass(frozen=True)
class TableLike:
    """Anything that can be queried by its id."""

    id: TableId
    partitioning: Scheme = field(default_factory=NotPartitioned)

    @property
    def unpartitioned(self) -> TableLike:
        return replace(self, partitioning=Ignored(self.partitioning))

    @property
    def whole_table(self) -> WholeTable:
        return WholeTable(self)

    def partition(self, value) -> PartitionId:
        """One partition. Only tables with a scheme have any."""
        if isinstance(self.partitioning, (NotPartitioned, Ignored)):
            raise TypeError(f"{self.id} has no partitions to name; declare how it is partitioned, or read it as a whole")
        return PartitionId(self, value)

    def frame(self, spark: SparkSession) -> DataFrame:
        df = spark.table(self.id.sql)
        schema = getattr(self, "schema", None)
        return df.select(*[Ident(f"`{n}`").sql for n in schema.names]) if schema else df


@dataclass(frozen=True)
class WholeTable:
    """All partitions, on purpose."""

    table: TableLike


@dataclass(frozen=True)
class TableRef(TableLike):
    """A table whose schema is found when it is read."""

    labels: TableLabels = field(default_factory=TableLabels, hash=False)


@dataclass(frozen=True)
class Definition(TableLike):
    schema: Schema = field(default_factory=Schema)
    description: str | None = None
    labels: TableLabels = field(default_factory=TableLabels, hash=False)

    def __post_init__(self):
        column = self.partitioning.column
        if column and len(self.schema) and self.schema.get(column) is None:
            raise ValueError(f"{self.id} is partitioned by {column}, which it lacks")


@dataclass(frozen=True)
class Table(Definition):
    clustering: tuple[str, ...] = ()
    options: TableOptions = TableOptions()

    def with_partitioning(self, scheme: Scheme) -> Table:
        return replace(self, partitioning=scheme)


@dataclass(frozen=True)
class View(Definition):
    """A named query; how it is partitioned is a promise about a column of it."""

    query: Frag | None = None


@dataclass(frozen=True)
class MaterializedView(Definition):
    """A query whose result is kept and made anew when it is older than the interval."""

    query: Frag | None = None
    enable_refresh: bool = True
    refresh_interval_ms: int = 1_800_000
    options: TableOptions = TableOptions()


@dataclass(frozen=True)
class Fill:
    """One partition of a table as a job makes it from a query."""

    job: str
    table: Table
    query: Frag
    value: object

    @property
    def destination(self) -> PartitionId:
        return self.table.partition(self.value)


@dataclass(frozen=True)
class FilledTable:
    """A table with the query that makes each of its days."""

    job: str
    table: Table
    query: object  # date -> Frag

    def with_date(self, day) -> Fill:
        return Fill(self.job, self.table, self.query(day), day)
