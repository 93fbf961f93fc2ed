"""SQL fragments: text with tables, partitions, functions and values in it.

A fragment renders to Spark SQL and knows what it depends on. Values become literals,
escaped; a table that is partitioned has to be named by partitions or as a whole.
"""

from __future__ import annotations

import string
import textwrap
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillspark.functions.routines import TvfCall, Udf, UdfCall
from quillspark.ids import Ident
from quillspark.literals import literal
from quillspark.partition import Day, Hour, Ignored, IntRange, NotPartitioned, PartitionId, Sharded, Timed, newest_first
from quillspark.tables import Fill, FilledTable, TableLike, View, WholeTable
from quillspark.types import TypeOf


@dataclass(frozen=True, eq=False)
class Frag:
    """Parts: text, or what stands for a table, function or further fragment. Equal if rendered alike."""

    parts: tuple

    @property
    def sql(self) -> str:
        return "".join(_render(p) for p in self.parts)

    @property
    def script(self) -> list[str]:
        """Statements that define the temporary functions, in order of need, and then the query."""
        return [*(u.create_sql() for u in self.temporary_functions() if not u.untyped), self.sql]

    def run(self, spark: SparkSession) -> DataFrame:
        """The frame of the query; temporary functions are registered first."""
        for routine in self.routines():
            routine.register(spark)
        return spark.sql(self.sql)

    def __eq__(self, other) -> bool:
        return isinstance(other, Frag) and self.script == other.script

    def __hash__(self) -> int:
        return hash(self.sql)

    def __add__(self, other: Frag) -> Frag:
        return Frag((*self.parts, *other.parts))

    def dedent(self) -> Frag:
        return Frag(tuple(textwrap.dedent(p) if isinstance(p, str) else p for p in self.parts))

    # what it depends on

    def collect(self, pick: Callable) -> list:
        """What ``pick`` gives, other than None, for each part: bodies of functions first, then calls in order."""
        out = []

        def walk(part) -> None:
            for inner in _inside(part):
                walk(inner)
            if (x := pick(part)) is not None:
                out.append(x)

        for part in self.parts:
            walk(part)
        return out

    def routines(self) -> list:
        """Functions to register before the query, each once, those that others need first."""
        found = self.collect(lambda p: p.udf if isinstance(p, UdfCall) else p.tvf.as_temporary() if isinstance(p, TvfCall) else None)
        return [r for r in dict.fromkeys(found) if r.temporary]

    def temporary_functions(self) -> list[Udf]:
        return [r for r in self.routines() if isinstance(r, Udf)]

    def functions(self) -> list[Udf]:
        return list(dict.fromkeys(self.collect(lambda p: p.udf if isinstance(p, UdfCall) else None)))

    def tables(self, expand_views: bool = True) -> list[TableLike]:
        """Tables that are read; views and table functions are replaced by what they read."""
        out: list[TableLike] = []
        for ref in self.collect(_reference):
            table = ref.table if isinstance(ref, (PartitionId, WholeTable)) else ref
            if expand_views and isinstance(table, View) and table.query is not None:
                out += table.query.tables()
            elif expand_views and isinstance(table, TvfCall):
                out += table.tvf.query.tables()
            else:
                out.append(table)
        return list(dict.fromkeys(out))

    def partitions(self, expand_views: bool = True) -> list[PartitionId | WholeTable]:
        """Partitions that are read. The day or hour of a view's partition goes on to tables split alike within it."""
        out: list = []
        for ref in self.collect(_reference):
            out += _expanded(ref, None) if expand_views else [_as_partition(ref)]
        return [p for p in dict.fromkeys(out) if p is not None]


def _as_partition(ref):
    if isinstance(ref, (PartitionId, WholeTable)):
        return ref
    return WholeTable(ref) if isinstance(ref, TableLike) else None


def _expanded(ref, outer: PartitionId | None) -> list:
    """``outer``: the partition of the view that ``ref`` stands in."""
    table = ref.table if isinstance(ref, (PartitionId, WholeTable)) else ref
    inner = table.query if isinstance(table, View) else table.tvf.query if isinstance(table, TvfCall) else None
    if inner is not None:
        own = ref if isinstance(ref, PartitionId) else outer
        return [x for r in inner.collect(_reference) for x in _expanded(r, own)]
    if isinstance(ref, PartitionId):
        return [ref]
    scheme = table.partitioning.original if isinstance(table.partitioning, Ignored) else table.partitioning
    if outer is not None and isinstance(scheme, (Day, Hour)) and type(scheme) is type(outer.scheme):
        bare = TableLike(table.id, scheme) if isinstance(table.partitioning, Ignored) else table
        return [PartitionId(bare, outer.value)]
    return [WholeTable(table)]


def _reference(part):
    if isinstance(part, Fill):
        return part.destination
    return part if isinstance(part, (PartitionId, TableLike, WholeTable, TvfCall)) else None


def _inside(part) -> Iterable:
    if isinstance(part, UdfCall):
        body = part.udf.body
        yield from body.parts if isinstance(body, Frag) else ()
        for a in part.args:
            yield from a.parts if isinstance(a, Frag) else ()
    elif isinstance(part, TvfCall):
        for a in part.args:
            yield from a.parts if isinstance(a, Frag) else ()
        # temporary functions of the body are needed too; its tables are found by expansion
        yield from (p for p in part.tvf.query.parts if isinstance(p, UdfCall))
    elif isinstance(part, Frag):
        yield from part.parts
    elif isinstance(part, PartitionUnion):
        yield from part.partitions


@dataclass(frozen=True)
class PartitionUnion:
    """Partitions read together."""

    partitions: tuple[PartitionId, ...]

    @property
    def sql(self) -> str:
        selects = [_select(table, own) for table, own in by_table(self.partitions)]
        if len(selects) == 1:
            return f"({selects[0]})"
        return "(" + " UNION ALL ".join(selects) + ")"


def by_table(partitions: Iterable[PartitionId]) -> list[tuple[TableLike, list[PartitionId]]]:
    """Distinct partitions by table: newest first within a table, tables by their scheme, then as they came."""
    own = list(dict.fromkeys(partitions))
    if not own:
        raise ValueError("no partitions to read")
    tables: dict = {}
    for p in own:
        tables.setdefault(p.table, []).append(p)
    return sorted(((t, newest_first(ps)) for t, ps in tables.items()), key=lambda x: x[0].partitioning.order)


def _select(table: TableLike, partitions: list[PartitionId]) -> str:
    """One scan of the table for all of its partitions."""
    scheme = table.partitioning
    if isinstance(scheme, Sharded):
        return " UNION ALL ".join(f"SELECT * FROM {p.table_id.sql}" for p in partitions)
    if scheme.column is None:
        return f"SELECT * FROM {table.id.sql}"
    if isinstance(scheme, IntRange) or isinstance(scheme, Timed) and scheme.raw:
        where = " OR ".join(f"({scheme.predicate_sql(p.value)})" for p in partitions)
    elif len(partitions) == 1:
        where = scheme.predicate_sql(partitions[0].value)
    else:
        where = f"{Ident(scheme.column).sql} IN ({', '.join(literal(scheme.point(p.value)) for p in partitions)})"
    return f"SELECT * FROM {table.id.sql} WHERE {where}"


def _render(part) -> str:
    if isinstance(part, str):
        return part
    if isinstance(part, (Frag, PartitionId, PartitionUnion, UdfCall, TvfCall)):
        return part.sql
    if isinstance(part, WholeTable):
        return part.table.id.sql
    if isinstance(part, Fill):
        return part.destination.sql
    if isinstance(part, TableLike):
        return part.id.sql
    raise TypeError(f"{type(part).__name__} cannot stand in SQL")


def part_of(value):
    """What stands in a fragment for a value."""
    if isinstance(value, (Frag, PartitionId, WholeTable, UdfCall, TvfCall, Fill, PartitionUnion)):
        return value
    if isinstance(value, TableLike):
        if not isinstance(value.partitioning, (NotPartitioned, Ignored)):
            raise TypeError(f"{value.id} is partitioned: name partitions of it, .whole_table or .unpartitioned")
        return value
    if isinstance(value, FilledTable):
        return WholeTable(value.table)
    if isinstance(value, Ident):
        return value.sql
    if isinstance(value, TypeOf):
        return value.ddl()
    if isinstance(value, (list, tuple)) and (not value or isinstance(value[0], (PartitionId, Fill))):
        return PartitionUnion(tuple(v.destination if isinstance(v, Fill) else v for v in value))
    if isinstance(value, (list, tuple)) and isinstance(value[0], TableLike):
        parts = [part_of(v) for v in value]
        return Frag(("(", *[x for p in parts for x in (" UNION ALL ", "SELECT * FROM ", p)][1:], ")"))
    if isinstance(value, (list, tuple)) and isinstance(value[0], Ident):
        return ", ".join(i.sql for i in value)
    return literal(value)


def frag(text: str, **values) -> Frag:
    """``text`` with ``{name}`` replaced by ``values``; double braces stand for themselves."""
    parts: list = []
    for before, name, spec, conversion in string.Formatter().parse(text):
        if before:
            parts.append(before)
        if name is not None:
            if spec or conversion or name not in values:
                raise KeyError(f"{{{name}}} has no value")
            parts.append(part_of(values[name]))
    return Frag(tuple(parts))


def joined(items: Iterable, separator: str = ", ") -> Frag:
    """Values with a separator between."""
    parts: list = []
    for k, item in enumerate(items):
        parts += [separator] * bool(k) + [part_of(item)]
    return Frag(tuple(parts))


def conditions(*parts: Frag | None) -> Frag:
    """Those given, joined by AND; ``true`` if none is."""
    own = [p for p in parts if p is not None]
    return joined((frag("({p})", p=p) for p in own), " AND ") if own else frag("true")


def check_partition_filters(fragment: Frag) -> list[str]:
    """Tables that must be read by partition and are not."""
    out = []
    for p in fragment.partitions():
        options = getattr(p.table, "options", None) if isinstance(p, WholeTable) else None
        if options is not None and options.partition_filter_required:
            out.append(f"{p.table.id} needs a filter on {p.table.partitioning.column}")
    return out


