"""Partition schemes, partition ids, and lower bounds for listing partitions."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.errors import InvalidId
from quillspark.ids import Ident, TableId
from quillspark.literals import YearMonth, literal

if TYPE_CHECKING:
    from quillspark.tables import TableLike


@dataclass(frozen=True)
class Scheme:
    """How a table is split. ``value_type`` is what names a partition."""

    @property
    def column(self) -> str | None:
        """The partition column, where there is one."""
        return getattr(self, "field", None)

    value_type = type(None)
    order = 1

    def suffix(self, value) -> str:
        return ""

    def parse(self, suffix: str):
        return None

    def predicate(self, value) -> Column:
        return F.lit(True)

    def predicate_sql(self, value) -> str:
        return "true"

    def bucket(self, column: Column) -> Column:
        """The partition's value, from any value of the column."""
        return column

    def check(self, value) -> None:
        ok = isinstance(value, self.value_type) and (self.value_type is not int or not isinstance(value, bool))
        if not ok or self.value_type is dt.date and isinstance(value, dt.datetime):
            raise TypeError(f"{type(self).__name__} partitions are named by {self.value_type.__name__}, not {value!r}")


@dataclass(frozen=True)
class Timed(Scheme):
    """By time. ``raw``: the column holds instants rather than the partition's own value, and a partition is a range of them."""

    field: str
    raw: bool = False

    def __post_init__(self):
        Ident(self.field)

    def span(self, value) -> tuple[dt.datetime, dt.datetime]:
        """First instant of the partition, and of the next one."""
        raise NotImplementedError

    def point(self, value):
        """The value that the partition column holds."""
        return value

    def predicate(self, value) -> Column:
        if self.raw:
            low, high = (F.expr(literal(v)) for v in self.span(value))
            return (F.col(self.field) >= low) & (F.col(self.field) < high)
        return F.col(self.field) == F.lit(self.point(value))

    def predicate_sql(self, value) -> str:
        column = Ident(self.field).sql
        if self.raw:
            low, high = self.span(value)
            return f"{column} >= {literal(low)} AND {column} < {literal(high)}"
        return f"{column} = {literal(self.point(value))}"


@dataclass(frozen=True)
class Hour(Timed):
    value_type, order = dt.datetime, 3

    def span(self, value):
        first = value.replace(minute=0, second=0, microsecond=0)
        return first, first + dt.timedelta(hours=1)

    def suffix(self, value) -> str:
        return value.strftime("%Y%m%d%H")

    def parse(self, suffix: str):
        return dt.datetime.strptime(suffix[-10:], "%Y%m%d%H")

    def bucket(self, column: Column) -> Column:
        return F.date_trunc("hour", column).cast("timestamp_ntz")


@dataclass(frozen=True)
class Day(Timed):
    value_type, order = dt.date, 2

    def span(self, value):
        first = dt.datetime.combine(value, dt.time())
        return first, first + dt.timedelta(days=1)

    def suffix(self, value) -> str:
        return value.strftime("%Y%m%d")

    def parse(self, suffix: str):
        return dt.datetime.strptime(suffix[-8:], "%Y%m%d").date()

    def bucket(self, column: Column) -> Column:
        return column.cast("date")


@dataclass(frozen=True)
class Month(Timed):
    value_type, order = YearMonth, 4

    def span(self, value):
        first, after = value.first_day, dt.date(value.year + value.month // 12, value.month % 12 + 1, 1)
        return dt.datetime.combine(first, dt.time()), dt.datetime.combine(after, dt.time())

    def point(self, value):
        return value.first_day

    def suffix(self, value) -> str:
        return f"{value.year:04}{value.month:02}"

    def parse(self, suffix: str):
        return YearMonth(int(suffix[-6:-2]), int(suffix[-2:]))

    def bucket(self, column: Column) -> Column:
        return F.trunc(column, "month")


@dataclass(frozen=True)
class IntRange(Scheme):
    """Windows of ``interval`` from ``start`` to ``end``, which is included."""

    field: str
    start: int = 0
    end: int = 4000
    interval: int = 1

    value_type, order = int, 5

    def __post_init__(self):
        Ident(self.field)
        if self.interval < 1 or self.end < self.start:
            raise InvalidId(f"range {self.start} to {self.end} by {self.interval}")

    def window(self, value: int) -> tuple[int, int]:
        """First and last value of the window of ``value``; of all windows for a value outside."""
        if not self.start <= value <= self.end:
            return self.start, self.end
        low = self.start + (value - self.start) // self.interval * self.interval
        return low, min(low + self.interval - 1, self.end)

    def suffix(self, value) -> str:
        return str(value)

    def parse(self, suffix: str):
        return int(suffix)

    def predicate(self, value) -> Column:
        return F.col(self.field).between(*self.window(value))

    def predicate_sql(self, value) -> str:
        low, high = self.window(value)
        return f"{Ident(self.field).sql} BETWEEN {literal(low)} AND {literal(high)}"

    def bucket(self, column: Column) -> Column:
        low = F.lit(self.start) + F.floor((column - self.start) / self.interval) * self.interval
        return F.when(column.between(self.start, self.end), low).otherwise(F.lit(self.start)).cast("long")


@dataclass(frozen=True)
class Sharded(Scheme):
    """A table for each day, named with the day."""

    value_type, order = dt.date, 0

    def suffix(self, value) -> str:
        return value.strftime("%Y%m%d")

    def parse(self, suffix: str):
        return dt.datetime.strptime(suffix[-8:], "%Y%m%d").date()


@dataclass(frozen=True)
class NotPartitioned(Scheme):
    pass


@dataclass(frozen=True)
class Ignored(Scheme):
    """A partitioned table read as if it were not."""

    original: Scheme


@dataclass(frozen=True)
class PartitionId:
    """One partition of a table."""

    table: TableLike
    value: object

    def __post_init__(self):
        self.scheme.check(self.value)
        if isinstance(self.scheme, Sharded) and self.table.id.table.endswith("_"):
            raise InvalidId(f"'{self.table.id.table}' is sharded; its name cannot end in '_'")

    @property
    def scheme(self) -> Scheme:
        return self.table.partitioning

    @property
    def table_id(self) -> TableId:
        """The id that names the partition itself."""
        own = self.table.id
        if isinstance(self.scheme, Sharded):
            return own.with_table(f"{own.table}_{self.scheme.suffix(self.value)}")
        suffix = self.scheme.suffix(self.value)
        return own.with_table(f"{own.table}${suffix}") if suffix else own

    @property
    def sql(self) -> str:
        """A sub-query of its rows."""
        if isinstance(self.scheme, Sharded):
            return f"(SELECT * FROM {self.table_id.sql})"
        if self.scheme.column is None:
            return f"(SELECT * FROM {self.table.id.sql})"
        return f"(SELECT * FROM {self.table.id.sql} WHERE {self.scheme.predicate_sql(self.value)})"

    def sort_key(self) -> tuple[str, str]:
        return self.scheme.suffix(self.value), str(self.table.id)


def newest_first(partitions: list[PartitionId]) -> list[PartitionId]:
    return sorted(partitions, key=PartitionId.sort_key, reverse=True)


# lower bounds


@dataclass(frozen=True)
class Start:
    """Partitions from ``value`` on; all of them for None."""

    value: object = None

    def for_scheme(self, scheme: Scheme) -> Start:
        """The bound in the scheme's own terms; one that has none there is no bound."""
        v = self.value
        if isinstance(scheme, Hour):
            return Start(v if isinstance(v, dt.datetime) else dt.datetime.combine(v, dt.time()) if isinstance(v, dt.date) else dt.datetime.combine(v.first_day, dt.time()) if isinstance(v, YearMonth) else None)
        if isinstance(scheme, (Day, Sharded)):
            return Start(v.date() if isinstance(v, dt.datetime) else v if isinstance(v, dt.date) else v.first_day if isinstance(v, YearMonth) else None)
        if isinstance(scheme, Month):
            return Start(YearMonth(v.year, v.month) if isinstance(v, (dt.date, YearMonth)) else None)
        if isinstance(scheme, IntRange):
            return Start(v if isinstance(v, int) else None)
        return Start()

    def admits(self, value) -> bool:
        point = lambda x: x.first_day if isinstance(x, YearMonth) else x
        return self.value is None or point(value) >= point(self.value)

    def predicate(self, scheme: Scheme) -> Column:
        own = self.for_scheme(scheme).value
        if own is None or scheme.column is None:
            return F.lit(True)
        return F.col(scheme.column) >= F.lit(own.first_day if isinstance(own, YearMonth) else own)
