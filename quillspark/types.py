"""Column types, modes, fields and schemas, and what they are in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import types as T


class Mode(Enum):
    REQUIRED = "REQUIRED"
    NULLABLE = "NULLABLE"
    REPEATED = "REPEATED"


class Type(Enum):
    BOOL = "BOOL"
    INT64 = "INT64"
    FLOAT64 = "FLOAT64"
    NUMERIC = "NUMERIC"
    BIGNUMERIC = "BIGNUMERIC"
    STRING = "STRING"
    BYTES = "BYTES"
    STRUCT = "STRUCT"
    ARRAY = "ARRAY"
    TIMESTAMP = "TIMESTAMP"
    DATE = "DATE"
    TIME = "TIME"
    DATETIME = "DATETIME"
    GEOGRAPHY = "GEOGRAPHY"
    JSON = "JSON"
    INTERVAL = "INTERVAL"
    RANGE = "RANGE"


# What Spark has no type for is kept in another, and named in the column's metadata: a
# decimal of 38 digits, WKT or JSON text, or a struct of parts.
_SPARK: dict[Type, T.DataType] = {
    Type.BOOL: T.BooleanType(),
    Type.INT64: T.LongType(),
    Type.FLOAT64: T.DoubleType(),
    Type.NUMERIC: T.DecimalType(38, 9),
    Type.BIGNUMERIC: T.DecimalType(38, 18),
    Type.STRING: T.StringType(),
    Type.BYTES: T.BinaryType(),
    Type.TIMESTAMP: T.TimestampType(),
    Type.DATE: T.DateType(),
    Type.TIME: T.TimeType(6),
    Type.DATETIME: T.TimestampNTZType(),
    Type.GEOGRAPHY: T.StringType(),
    Type.JSON: T.StringType(),
    Type.INTERVAL: T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())]),
    Type.RANGE: T.StructType([T.StructField("start", T.StringType()), T.StructField("end", T.StringType())]),
}
_LOGICAL = (Type.BIGNUMERIC, Type.GEOGRAPHY, Type.JSON, Type.INTERVAL, Type.RANGE)
_BACK = {T.BooleanType: Type.BOOL, T.ByteType: Type.INT64, T.ShortType: Type.INT64, T.IntegerType: Type.INT64, T.LongType: Type.INT64, T.FloatType: Type.FLOAT64, T.DoubleType: Type.FLOAT64, T.DecimalType: Type.NUMERIC, T.StringType: Type.STRING, T.BinaryType: Type.BYTES, T.TimestampType: Type.TIMESTAMP, T.TimestampNTZType: Type.DATETIME, T.DateType: Type.DATE, T.TimeType: Type.TIME}


@dataclass(frozen=True)
class Field:
    name: str
    type: Type
    mode: Mode = Mode.NULLABLE
    description: str | None = None
    fields: tuple[Field, ...] = ()
    policy_tags: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))

    @classmethod
    def struct(cls, name: str, *fields: Field, mode: Mode = Mode.NULLABLE) -> Field:
        return cls(name, Type.STRUCT, mode, fields=fields)

    @classmethod
    def repeated(cls, name: str, kind: Type) -> Field:
        return cls(name, kind, Mode.REPEATED)

    @classmethod
    def repeated_struct(cls, name: str, *fields: Field) -> Field:
        return cls(name, Type.STRUCT, Mode.REPEATED, fields=fields)

    def with_name(self, name: str) -> Field:
        return replace(self, name=name)

    def with_type(self, kind: Type) -> Field:
        return replace(self, type=kind)

    def with_mode(self, mode: Mode) -> Field:
        return replace(self, mode=mode)

    def with_description(self, text: str | None) -> Field:
        return replace(self, description=text)

    def with_fields(self, *fields: Field) -> Field:
        """Other parts of a struct; any other field stays as it is."""
        return replace(self, fields=fields) if self.type is Type.STRUCT else self

    def with_policy_tags(self, *tags: str) -> Field:
        return replace(self, policy_tags=tags)

    def required(self) -> Field:
        return self.with_mode(Mode.REQUIRED)

    def nullable(self) -> Field:
        return self.with_mode(Mode.NULLABLE)

    def recursively_nullable(self) -> Field:
        mode = Mode.REPEATED if self.mode is Mode.REPEATED else Mode.NULLABLE
        return replace(self, mode=mode, fields=tuple(f.recursively_nullable() for f in self.fields))

    def has_required(self) -> bool:
        return self.mode is Mode.REQUIRED or any(f.has_required() for f in self.fields)

    @property
    def element(self) -> T.DataType:
        """Spark's type of one value."""
        if self.type is Type.STRUCT:
            return T.StructType([f.to_spark() for f in self.fields])
        if self.type is Type.ARRAY:
            return T.ArrayType(self.fields[0].element, False)
        return _SPARK[self.type]

    def to_spark(self) -> T.StructField:
        metadata = {k: v for k, v in (("comment", self.description), ("policyTags", list(self.policy_tags)), ("logical", self.type.value if self.type in _LOGICAL else None)) if v}
        kind = T.ArrayType(self.element, False) if self.mode is Mode.REPEATED else self.element
        return T.StructField(self.name, kind, self.mode is Mode.NULLABLE, metadata)

    @classmethod
    def from_spark(cls, f: T.StructField) -> Field:
        mode, kind = (Mode.NULLABLE if f.nullable else Mode.REQUIRED), f.dataType
        if isinstance(kind, T.ArrayType):
            mode, kind = Mode.REPEATED, kind.elementType
        logical = (f.metadata or {}).get("logical")
        if logical:
            own, fields = Type(logical), ()
        elif isinstance(kind, T.StructType):
            own, fields = Type.STRUCT, tuple(cls.from_spark(x) for x in kind.fields)
        elif isinstance(kind, T.ArrayType):
            inner = cls.from_spark(T.StructField("element", kind.elementType))
            own, fields = Type.ARRAY, (inner,)
        else:
            own, fields = _BACK.get(type(kind)), ()
            if own is None:
                raise TypeError(f"column {f.name}: {kind.simpleString()} has no counterpart")
        return cls(f.name, own, mode, (f.metadata or {}).get("comment"), fields, tuple((f.metadata or {}).get("policyTags", ())))

    def to_json(self) -> dict:
        out = {"name": self.name, "type": self.type.value, "mode": self.mode.value}
        return out | {k: v for k, v in (("description", self.description), ("fields", [f.to_json() for f in self.fields]), ("policyTags", list(self.policy_tags))) if v}

    @classmethod
    def from_json(cls, x: dict) -> Field:
        return cls(x["name"], Type(x["type"]), Mode(x.get("mode", "NULLABLE")), x.get("description"), tuple(cls.from_json(f) for f in x.get("fields", ())), tuple(x.get("policyTags", ())))


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))

    @classmethod
    def of(cls, *fields: Field) -> Schema:
        return cls(fields)

    def __iter__(self):
        return iter(self.fields)

    def __len__(self):
        return len(self.fields)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def extend(self, more: Iterable[Field]) -> Schema:
        return Schema((*self.fields, *more))

    def filter(self, test: Callable[[Field], bool]) -> Schema:
        return Schema(f for f in self.fields if test(f))

    def filter_not(self, test: Callable[[Field], bool]) -> Schema:
        return self.filter(lambda f: not test(f))

    def recursively_nullable(self) -> Schema:
        """As a view has it: no column of a view is required."""
        return Schema(f.recursively_nullable() for f in self.fields)

    def required_fields(self) -> list[Field]:
        """Top-level fields that are required or hold a required one."""
        return [f for f in self.fields if f.has_required()]

    def to_spark(self) -> T.StructType:
        return T.StructType([f.to_spark() for f in self.fields])

    @classmethod
    def from_spark(cls, schema: T.StructType) -> Schema:
        return cls(Field.from_spark(f) for f in schema.fields)

    def to_json(self) -> list[dict]:
        return [f.to_json() for f in self.fields]

    @classmethod
    def from_json(cls, x: list[dict]) -> Schema:
        return cls(Field.from_json(f) for f in x)

    def ddl(self) -> str:
        from quillspark.ids import quote

        return ", ".join(f"{quote(f.name)} {type_of(f).ddl()}{'' if f.mode is not Mode.REQUIRED else ' NOT NULL'}{comment(f.description)}" for f in self.fields)


def comment(text: str | None) -> str:
    from quillspark.literals import string

    return f" COMMENT {string(text)}" if text else ""


@dataclass(frozen=True)
class TypeOf:
    """A type without a name of its own; names are within structs alone."""

    mode: Mode
    type: Type
    fields: tuple[tuple[str, TypeOf], ...] = ()

    def ddl(self) -> str:
        """The type in Spark's DDL."""
        return _field("x", self).to_spark().dataType.simpleString()

    def show(self) -> str:
        """The type by its own names: ``ARRAY<STRUCT<foo STRING>>``."""
        if self.type is Type.ARRAY:
            own = f"ARRAY<{self.fields[0][1].show()}>"
        elif self.type is Type.STRUCT:
            own = f"STRUCT<{', '.join(f'{n} {t.show()}' for n, t in self.fields)}>"
        else:
            own = self.type.value
        return f"ARRAY<{own}>" if self.mode is Mode.REPEATED else own

    def nullable(self) -> TypeOf:
        return replace(self, mode=Mode.NULLABLE)

    def repeated(self) -> TypeOf:
        return replace(self, mode=Mode.REPEATED)

    def as_schema(self) -> Schema:
        if self.type is not Type.STRUCT:
            raise TypeError(f"{self.show()} is not a struct")
        return Schema(_field(n, t) for n, t in self.fields)


def _field(name: str, t: TypeOf) -> Field:
    return Field(name, t.type, t.mode, fields=tuple(_field(n, x) for n, x in t.fields))


def type_of(f: Field) -> TypeOf:
    return TypeOf(f.mode, f.type, tuple((x.name, type_of(x)) for x in f.fields))


def type_of_schema(schema: Schema) -> TypeOf:
    """One column: its type, without its name; more: a struct of them."""
    if len(schema) == 1:
        return type_of(schema.fields[0])
    return TypeOf(Mode.REQUIRED, Type.STRUCT, tuple((f.name, type_of(f)) for f in schema))


def dictionary(value: Type) -> TypeOf:
    """Pairs of a number and a value, as an array of structs."""
    return TypeOf(Mode.REPEATED, Type.STRUCT, (("index", TypeOf(Mode.NULLABLE, Type.INT64)), ("value", TypeOf(Mode.NULLABLE, value))))
