"""What has to be done so that the catalog holds a definition, and doing it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from quillspark.errors import IllegalUpdate
from quillspark.functions.routines import Tvf, Udf
from quillspark.partition import Day, Month
from quillspark.plans.catalog import Catalog
from quillspark.plans.conforms import only_types
from quillspark.tables import Definition, MaterializedView, Table, TableOptions, View
from quillspark.types import Field, Schema


@dataclass(frozen=True)
class Noop:
    existing: object


@dataclass(frozen=True)
class Create:
    wanted: Definition


@dataclass(frozen=True)
class Update:
    existing: Table
    wanted: Table


@dataclass(frozen=True)
class Recreate:
    """Drop and make anew; nothing is lost, as it is a query."""

    existing: Definition
    wanted: Definition


@dataclass(frozen=True)
class CreateRoutine:
    wanted: Udf | Tvf


@dataclass(frozen=True)
class UpdateRoutine:
    existing: Udf | Tvf
    wanted: Udf | Tvf


@dataclass(frozen=True)
class Illegal:
    existing: object
    wanted: object
    reason: str


@dataclass(frozen=True)
class UnsupportedPartitioning(Illegal):
    pass


@dataclass(frozen=True)
class IllegalExtension(Illegal):
    pass


def plan(wanted: Definition, existing: Definition | None):
    """The operation that turns ``existing`` into ``wanted``."""
    if existing is None:
        return Create(wanted)
    if type(wanted) is not type(existing):
        return Illegal(existing, wanted, f"cannot make a {type(wanted).__name__} of a {type(existing).__name__}")
    if isinstance(wanted, View):
        # how a view is partitioned is a promise, not part of it
        same = _bare_view(wanted) == _bare_view(existing)
        return Noop(existing) if same else Recreate(existing, wanted)
    if wanted.partitioning != existing.partitioning:
        return UnsupportedPartitioning(existing, wanted, f"cannot change partitioning from {existing.partitioning} to {wanted.partitioning}")
    if isinstance(wanted, MaterializedView):
        return Noop(existing) if _bare_mv(wanted) == _bare_mv(existing) else Recreate(existing, wanted)
    if wanted == existing:
        return Noop(existing)
    if problems := extension_problems(existing.schema, wanted.schema):
        return IllegalExtension(existing, wanted, "; ".join(problems))
    return Update(existing, wanted)


def extension_problems(have: Schema, want: Schema) -> list[str]:
    """Fields may be added at the end, in structs too, and nothing else."""
    return only_types(want, have)


def _bare_view(v: View):
    return (v.id, v.description, dict(v.labels), tuple(v.schema.recursively_nullable()) if len(v.schema) else (), v.query.sql)


def _bare_mv(v: MaterializedView):
    def bare(f: Field):
        return (f.name, f.type, tuple(bare(x) for x in f.fields))

    options = v.options if isinstance(v.partitioning, (Day, Month)) else replace(v.options, partition_filter_required=False)
    return (v.id, dict(v.labels), v.query.sql, v.enable_refresh, v.refresh_interval_ms, options or TableOptions(), tuple(bare(f) for f in v.schema))


def plan_routine(wanted: Udf | Tvf, existing: Udf | Tvf | None):
    if existing is None:
        return CreateRoutine(wanted)
    if type(wanted) is not type(existing):
        return Illegal(existing, wanted, f"cannot make a {type(wanted).__name__} of a {type(existing).__name__}")
    if isinstance(wanted, Udf):
        same = (wanted.name, wanted.params, wanted.body, wanted.returns) == (existing.name, existing.params, existing.body, existing.returns)
    else:
        same = (wanted.name, wanted.params, wanted.query, wanted.schema, wanted.description) == (existing.name, existing.params, existing.query, existing.schema, existing.description)
    return Noop(existing) if same else UpdateRoutine(existing, wanted)


class EnsureUpdated:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def check(self, wanted):
        """The operation, without doing it."""
        if isinstance(wanted, (Udf, Tvf)):
            return plan_routine(wanted, self.catalog.routine(wanted.name, wanted.dataset))
        return plan(wanted, self.catalog.table(wanted.id))

    def perform(self, operation) -> None:
        if isinstance(operation, Illegal):
            raise IllegalUpdate(operation.reason)
        if isinstance(operation, Create):
            self.catalog.create_table(operation.wanted)
        elif isinstance(operation, Update):
            self.catalog.update_table(operation.wanted)
        elif isinstance(operation, Recreate):
            self.catalog.delete_table(operation.existing.id)
            self.catalog.create_table(operation.wanted)
        elif isinstance(operation, (CreateRoutine, UpdateRoutine)):
            self.catalog.create_routine(operation.wanted)

    def ensure(self, wanted):
        operation = self.check(wanted)
        self.perform(operation)
        return operation
