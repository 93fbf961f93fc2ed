"""Recursive projection of a struct: each field is kept, dropped, renamed or flattened.

Arrays of structs are projected element by element, in order. A null array stays null and
an empty one empty. A null struct that is rebuilt stays null. An array whose elements are
left with one field becomes an array of that field.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.types import Field, Mode, Type


@dataclass(frozen=True)
class Keep:
    pass


@dataclass(frozen=True)
class Drop:
    pass


@dataclass(frozen=True)
class Rename:
    to: str


@dataclass(frozen=True)
class Flatten:
    """The fields of a struct take its place; ``prefix`` begins their names."""

    prefix: str | None = None


Op = Keep | Drop | Rename | Flatten


def project(field: Field, op: Callable[[Field], Op], column: Column | None = None) -> tuple[Column, Field] | None:
    """The projected column and its field, or None where nothing is left. ``op`` is asked about every field below."""
    column = F.col(f"`{field.name}`") if column is None else column
    out = _value(field, column, op)
    if out is None:
        return None
    return out[0].alias(out[1].name), out[1]


def _is_struct(f: Field) -> bool:
    return f.type is Type.STRUCT or f.type is Type.ARRAY and bool(f.fields) and f.fields[0].type is Type.STRUCT


def _value(f: Field, column: Column, op) -> tuple[Column, Field, bool] | None:
    """(column, field, changed)."""
    if f.type is Type.STRUCT and f.mode is Mode.REPEATED:
        return _array(f, f.fields, column, op, lambda fields: replace(f, fields=fields))
    if f.type is Type.ARRAY and f.fields and f.fields[0].type is Type.STRUCT:
        return _array(f, f.fields[0].fields, column, op, lambda fields: replace(f, fields=(replace(f.fields[0], fields=fields),)))
    if f.type is not Type.STRUCT:
        return column, f, False
    parts = _parts(f.fields, column, op)
    if not parts:
        return None
    fields = tuple(p[1] for p in parts)
    if not any(p[2] for p in parts) and fields == f.fields:
        return column, f, False
    built = F.struct(*[c.alias(x.name) for c, x, _ in parts])
    kept = built if f.mode is Mode.REQUIRED else F.when(column.isNotNull(), built)
    return kept, replace(f, fields=fields), True


def _array(f: Field, elements: tuple[Field, ...], column: Column, op, rebuilt) -> tuple[Column, Field, bool] | None:
    def of(e: Column):
        return _parts(elements, e, op)

    parts = of(F.lit(None))
    if not parts:
        return None
    fields = tuple(p[1] for p in parts)
    if len(parts) == 1:
        only = fields[0]
        own = replace(only, name=f.name, mode=Mode.REPEATED) if only.mode is not Mode.REPEATED else Field(f.name, Type.ARRAY, Mode.REPEATED, fields=(only,))
        return F.transform(column, lambda e: of(e)[0][0]), own, True
    if not any(p[2] for p in parts) and fields == elements:
        return column, f, False
    return F.transform(column, lambda e: F.struct(*[c.alias(x.name) for c, x, _ in of(e)])), rebuilt(fields), True


def _parts(fields: tuple[Field, ...], parent: Column, op) -> list[tuple[Column, Field, bool]]:
    out: list[tuple[Column, Field, bool]] = []
    for f in fields:
        do = op(f)
        if isinstance(do, Drop):
            continue
        column = parent.getField(f.name)
        if isinstance(do, Flatten):
            if f.type is not Type.STRUCT or f.mode is Mode.REPEATED:
                raise TypeError(f"{f.name} is not a struct and cannot be flattened")
            for c, x, _ in _parts(f.fields, column, op):
                name = do.prefix + x.name[:1].upper() + x.name[1:] if do.prefix else x.name
                mode = Mode.NULLABLE if f.mode is Mode.NULLABLE and x.mode is Mode.REQUIRED else x.mode
                out.append((c, replace(x, name=name, mode=mode), True))
            continue
        if (inner := _value(f, column, op)) is None:
            continue
        c, x, changed = inner
        if isinstance(do, Rename):
            x, changed = replace(x, name=do.to), True
        out.append((c, x, changed))
    return out
