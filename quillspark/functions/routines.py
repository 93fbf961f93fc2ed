"""Scalar functions in SQL or Python, references to functions, and table functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession

from quillspark.ids import DatasetRef, Ident, quote
from quillspark.types import Field, Schema, TypeOf, comment, type_of

if TYPE_CHECKING:
    from quillspark.fragment import Frag

MOST_PARAMS = 22


@dataclass(frozen=True)
class Param:
    """A parameter. Without a type it takes that of its argument, in each call anew; only temporary SQL functions may have such."""

    name: str
    type: TypeOf | None = None

    @classmethod
    def of(cls, f: Field) -> Param:
        return cls(f.name, type_of(f))


def _called(name: str, params: tuple[Param, ...], args: tuple) -> str:
    from quillspark.fragment import _render

    return f"{name}({', '.join(_render(a) for a in args)})"


def _arguments(what: str, params: tuple[Param, ...], args: tuple) -> tuple:
    from quillspark.fragment import Frag, part_of

    if len(args) != len(params):
        raise TypeError(f"{what} takes {len(params)} arguments, not {len(args)}")
    return tuple(a if isinstance(a, Frag) else Frag((part_of(a),)) for a in args)


@dataclass(frozen=True)
class Udf:
    """A scalar function. ``body``: a fragment over its parameters, a Python function, or None for one declared elsewhere."""

    name: str
    params: tuple[Param, ...]
    body: Frag | Callable | None
    returns: TypeOf
    dataset: DatasetRef | None = None

    def __post_init__(self):
        Ident(self.name)
        if len(self.params) > MOST_PARAMS:
            raise TypeError(f"{self.name}: at most {MOST_PARAMS} parameters")

    @property
    def temporary(self) -> bool:
        return self.dataset is None and self.body is not None

    @property
    def sql_name(self) -> str:
        return quote(self.name) if self.dataset is None else f"{quote(self.dataset.database)}.{quote(self.name)}"

    @property
    def untyped(self) -> bool:
        return any(p.type is None for p in self.params)

    def __call__(self, *args) -> Frag:
        from quillspark.fragment import Frag

        if self.untyped and (self.dataset is not None or not hasattr(self.body, "sql")):
            raise TypeError(f"{self.name}: only temporary SQL functions may have parameters without types")
        return Frag((UdfCall(self, _arguments(self.name, self.params, args)),))

    def as_temporary(self) -> Udf:
        """The same body as a function of the session."""
        return Udf(self.name, self.params, self.body, self.returns)

    def create_sql(self) -> str:
        if callable(self.body) and not hasattr(self.body, "sql"):
            return f"-- {self.name}: registered from Python"
        if untyped := [p.name for p in self.params if p.type is None]:
            raise TypeError(f"{self.name}: SQL functions need the types of {', '.join(untyped)}")
        params = ", ".join(f"{quote(p.name)} {p.type.ddl()}" for p in self.params)
        kind = "TEMPORARY FUNCTION" if self.temporary else "FUNCTION"
        return f"CREATE OR REPLACE {kind} {self.sql_name}({params}) RETURNS {self.returns.ddl()} RETURN {self.body.sql}"

    def register(self, spark: SparkSession) -> None:
        if self.body is None or self.temporary and self.untyped:
            return  # a call of the latter holds the body
        if hasattr(self.body, "sql"):
            if not self.temporary:
                for inner in self.body.functions():
                    if inner.temporary:
                        raise TypeError(f"{self.name} is persistent and cannot use the temporary {inner.name}")
            spark.sql(self.create_sql())
        elif self.temporary:
            spark.udf.register(self.name, self.body, self.returns.ddl())
        else:
            raise TypeError(f"{self.name}: a Python body makes a temporary function only")


@dataclass(frozen=True)
class UdfCall:
    udf: Udf
    args: tuple

    @property
    def sql(self) -> str:
        if not self.udf.untyped:
            return _called(self.udf.sql_name, self.udf.params, self.args)
        from quillspark.fragment import _render

        # each parameter is the variable of a lambda over an array of its argument, and so of any type
        out = f"CAST({self.udf.body.sql} AS {self.udf.returns.ddl()})"
        for p, a in reversed(list(zip(self.udf.params, self.args, strict=True))):
            out = f"element_at(transform(array({_render(a)}), {quote(p.name)} -> {out}), 1)"
        return out


@dataclass(frozen=True)
class Tvf:
    """A query with parameters, used as a table."""

    name: str
    params: tuple[Param, ...]
    query: Frag
    schema: Schema
    dataset: DatasetRef | None = None
    description: str | None = None

    @property
    def temporary(self) -> bool:
        return self.dataset is None

    @property
    def sql_name(self) -> str:
        return quote(self.name) if self.dataset is None else f"{quote(self.dataset.database)}.{quote(self.name)}"

    def __call__(self, *args) -> TvfCall:
        return TvfCall(self, _arguments(self.name, self.params, args))

    def create_sql(self) -> str:
        params = ", ".join(f"{quote(p.name)} {p.type.ddl()}" for p in self.params)
        columns = ", ".join(f"{quote(f.name)} {type_of(f).ddl()}" for f in self.schema)
        kind = "TEMPORARY FUNCTION" if self.temporary else "FUNCTION"
        return f"CREATE OR REPLACE {kind} {self.sql_name}({params}) RETURNS TABLE ({columns}){comment(self.description)} RETURN {self.query.sql}"

    def as_temporary(self) -> Tvf:
        return Tvf(self.name, self.params, self.query, self.schema, description=self.description)

    def register(self, spark: SparkSession) -> None:
        spark.sql(self.create_sql())


@dataclass(frozen=True)
class TvfCall:
    tvf: Tvf
    args: tuple

    @property
    def sql(self) -> str:
        # Spark takes no database in front of a table function, so a call is of its temporary twin
        return _called(quote(self.tvf.name), self.tvf.params, self.args)
