import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from quillspark.errors import InvalidId
from quillspark.ids import DatasetRef, Ident, JobLabels, ProjectId, TableId, TableLabels, job_name, safe_label
from quillspark.literals import YearMonth, decode, literal
from quillspark.types import Field, Mode, Schema, Type, TypeOf, dictionary, type_of, type_of_schema


@pytest.mark.parametrize("name", ["_5abc.dataField", "`5abc`.dataField", "abc5.GROUP", "`GROUP`.dataField", "a.b.c", "`!`"])
def test_idents_accepted(name):
    assert Ident(name).value == name


@pytest.mark.parametrize("name", ["", "5abc.dataField", "abc5!.dataField", "GROUP.dataField", "5s", "!s", "``", "a..b", ".a", "a."])
def test_idents_rejected(name):
    with pytest.raises(InvalidId):
        Ident(name)


@pytest.mark.parametrize("name", ["abcdef-", "1abcdef", "abc", "Abcdef", "a" * 31])
def test_projects_rejected(name):
    with pytest.raises(InvalidId):
        ProjectId(name)


@given(st.from_regex(r"[a-z][a-z0-9-]{4,28}[a-z0-9]", fullmatch=True), st.from_regex(r"[a-zA-Z0-9_]{1,40}", fullmatch=True), st.from_regex(r"[A-Za-z0-9_]{2,40}", fullmatch=True))
def test_table_ids_round_trip(project, dataset, table):
    t = TableId.of(project, dataset, table)
    assert TableId.parse(str(t)) == t
    assert TableId.parse(f"projects/{project}/datasets/{dataset}/tables/{table}") == t


@pytest.mark.parametrize("table", ["data_access_*", "service_daily$20200801", "with blank", "a-b"])
def test_table_names(table):
    assert TableId.of("my-project", "ds", table).table == table
    with pytest.raises(InvalidId):
        DatasetRef(ProjectId("my-project"), "a-b")


def test_labels():
    with pytest.raises(InvalidId) as e:
        JobLabels({"myJob": "Up", "": "x"})
    assert len(e.value.problems) == 3
    a, b = {"k": "left", "a": "1"}, {"k": "right"}
    assert (JobLabels(a) | JobLabels(b))["k"] == "left"
    assert (TableLabels(a) | TableLabels(b))["k"] == "right"
    assert list(JobLabels({"b": "1", "a": "2"})) == ["a", "b"]
    assert safe_label("  Hi There! ") == "hi_there_"
    assert job_name("pkg.mod.<lambda>.run!") == "pkg_mod__run"


ALL = Schema.of(
    *[Field(t.value.lower(), t) for t in Type if t not in (Type.STRUCT, Type.ARRAY, Type.INTERVAL, Type.RANGE)],
    Field.struct("s", Field("x", Type.INT64, Mode.REQUIRED), Field.repeated("ys", Type.STRING)),
    Field.repeated_struct("ss", Field("x", Type.INT64)),
)


def test_schema_round_trips(spark):
    assert Schema.from_spark(ALL.to_spark()) == ALL
    assert Schema.from_json(ALL.to_json()) == ALL
    described = Schema.of(Field("a", Type.STRING, Mode.REQUIRED, "what", policy_tags=("p",)))
    assert Schema.from_spark(described.to_spark()) == described
    f = ALL.get("numeric").to_spark()
    assert f.dataType == T.DecimalType(38, 9) and f.nullable


def test_modes():
    assert [f.name for f in ALL.required_fields()] == ["s"]
    assert not any(f.has_required() for f in ALL.recursively_nullable())
    assert ALL.recursively_nullable().get("ss").mode is Mode.REPEATED
    assert type_of(ALL.get("ss")).nullable().mode is Mode.NULLABLE
    assert len(ALL.extend([Field("z", Type.DATE)]).filter_not(lambda f: f.name == "z")) == len(ALL)
    assert Field("a", Type.STRING).with_fields(Field("b", Type.DATE)).fields == ()


def test_type_text():
    text = TypeOf(Mode.NULLABLE, Type.STRING)
    assert text.repeated().show() == "ARRAY<STRING>"
    s = TypeOf(Mode.REPEATED, Type.STRUCT, (("foo", text),))
    assert s.show() == "ARRAY<STRUCT<foo STRING>>" and s.ddl() == "array<struct<foo:string>>"
    assert dictionary(Type.STRING).show() == "ARRAY<STRUCT<index INT64, value STRING>>"
    assert type_of_schema(Schema.of(Field("a", Type.DATE))) == TypeOf(Mode.NULLABLE, Type.DATE)
    assert type_of_schema(ALL).as_schema().names == ALL.names
    with pytest.raises(TypeError):
        text.as_schema()


@pytest.mark.parametrize("value", [
    "", "a", "ø", "漢字", "😀", "it's", 'say "x"', "back\\slash", "two\nlines", "`tick`", "{brace}", 2**63 - 1, 0, -(2**63), True, False, 1.5, 1e300, -0.25,
    Decimal("1.25"), b"\x00\xff", dt.date(2020, 12, 31), dt.datetime(2020, 1, 2, 7, 12, 34, 123456), dt.time(1, 23, 59, 999), [1, 2], None,
])
def test_literals_come_back(spark, value):
    assert spark.sql(f"SELECT {literal(value)} AS x").first()[0] == value


@pytest.mark.parametrize("year", [1969, 2020, 2069])
def test_instants_come_back(spark, year):
    x = dt.datetime(year, 1, 2, 7, 12, 34, 123456, tzinfo=dt.UTC)
    assert spark.sql(f"SELECT unix_micros({literal(x)}) AS x").first()[0] == round((x - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1))


def test_what_has_no_literal():
    with pytest.raises(TypeError):
        literal(object())


def test_decoding(spark):
    from dataclasses import dataclass

    @dataclass
    class Inner:
        b: int
        c: int | None

    @dataclass
    class Outer:
        num: str
        nested: list[Inner]

    row = spark.sql("SELECT '1' AS x, array(named_struct('p', 1L, 'q', CAST(NULL AS BIGINT))) AS y").first()
    assert decode(row, Outer) == Outer("1", [Inner(1, None)])
    assert decode(row, tuple[str, list])[0] == "1"
    one = spark.sql("SELECT DATE'2020-03-04' AS d").first()
    assert decode(one, YearMonth) == YearMonth(2020, 3) and decode(one) == dt.date(2020, 3, 4)
    with pytest.raises(TypeError):
        decode(spark.sql("SELECT CAST(NULL AS BIGINT) AS x").first(), int)
