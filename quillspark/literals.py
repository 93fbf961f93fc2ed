"""Python values as Spark SQL literals, and rows as Python values."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import types as pytypes
import typing
from decimal import Decimal

from pyspark.sql import Row


def string(text: str) -> str:
    """A string literal; quotes, backslashes and line ends are escaped."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


@dataclasses.dataclass(frozen=True)
class YearMonth:
    year: int
    month: int

    @property
    def first_day(self) -> dt.date:
        return dt.date(self.year, self.month, 1)

    def __str__(self) -> str:
        return f"{self.year:04}-{self.month:02}"


@dataclasses.dataclass(frozen=True)
class Limit:
    """``LIMIT n``, or nothing for None."""

    n: int | None = None


def literal(value) -> str:
    """A literal of a plain value; anything else is a TypeError."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return f"{value}L" if -(2**63) < value < 2**63 else (f"{value}" if value > 0 else "(-9223372036854775807L - 1L)")
    if isinstance(value, float):
        return f"double({string(repr(value))})" if value != value or value in (float("inf"), float("-inf")) else f"{value!r}D"
    if isinstance(value, Decimal):
        return f"{value}BD"
    if isinstance(value, str):
        return string(value)
    if isinstance(value, (bytes, bytearray)):
        return f"X'{value.hex()}'"
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            return f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'"
        return f"TIMESTAMP'{value.astimezone(dt.UTC).strftime('%Y-%m-%d %H:%M:%S.%f')}Z'"
    if isinstance(value, dt.date):
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, dt.time):
        return f"TIME'{value.strftime('%H:%M:%S.%f')}'"
    if isinstance(value, YearMonth):
        return f"DATE'{value.first_day.isoformat()}'"
    if isinstance(value, Limit):
        return "" if value.n is None else f"LIMIT {value.n}"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(literal, value))})"
    raise TypeError(f"{type(value).__name__} cannot stand in SQL")


def decode(row: Row, to: type | None = None):
    """A row as ``to``: by position into a dataclass or tuple; one column gives its bare value."""
    if to is None:
        return row[0] if len(row) == 1 else row
    if len(row) == 1 and (to is YearMonth or not dataclasses.is_dataclass(to)):
        return _value(row[0], to)
    return _record(tuple(row), to)


def _record(values: tuple, to):
    if dataclasses.is_dataclass(to):
        hints = typing.get_type_hints(to)
        fields = dataclasses.fields(to)
        if len(fields) != len(values):
            raise TypeError(f"{to.__name__} has {len(fields)} fields, the row {len(values)}")
        return to(*(_value(v, hints[f.name]) for f, v in zip(fields, values, strict=True)))
    args = typing.get_args(to)
    return tuple(_value(v, t) for v, t in zip(values, args, strict=True)) if args else tuple(values)


def _value(value, to):
    origin, args = typing.get_origin(to), typing.get_args(to)
    if origin in (typing.Union, pytypes.UnionType):
        if value is None:
            if type(None) in args:
                return None
            raise TypeError("null where a value is needed")
        return _value(value, next(a for a in args if a is not type(None)))
    if value is None:
        if to in (typing.Any, None):
            return None
        raise TypeError(f"null where {to} is needed")
    if origin in (list, set, frozenset) or (origin is tuple and len(args) == 2 and args[1] is Ellipsis):
        return origin(_value(v, args[0]) for v in value)
    if to is YearMonth:
        return YearMonth(value.year, value.month)
    if to is dict and isinstance(value, str):
        return json.loads(value)
    if dataclasses.is_dataclass(to) or origin is tuple:
        return _record(tuple(value), to)
    if to is float and isinstance(value, int):
        return float(value)
    if isinstance(to, type) and to is not typing.Any and not isinstance(value, to):
        raise TypeError(f"{value!r} is not {to.__name__}")
    return value
