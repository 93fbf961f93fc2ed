import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillspark import Day, Field, Hour, IntRange, Month, Schema, Sharded, Table, TableId, TableRef, Type, View, frag, joined
from quillspark.fragment import Frag, check_partition_filters
from quillspark.functions.routines import Param, Tvf, Udf
from quillspark.literals import YearMonth
from quillspark.operators.scan import scan_partitions
from quillspark.partition import Start, newest_first
from quillspark.tables import FilledTable, TableOptions
from quillspark.types import Mode, TypeOf

LONG = TypeOf(Mode.NULLABLE, Type.INT64)
DAY = dt.date(2020, 1, 2)


def table(name, scheme=None, **more):
    return Table(TableId.of("my-project", "ds", name), scheme or Day("d"), Schema.of(Field("d", Type.DATE), Field("x", Type.INT64)), **more)


@pytest.mark.parametrize(("args", "value", "window"), [((1, 100, 1), 5, (5, 5)), ((1, 100, 10), 5, (1, 10)), ((1, 10, 2), 11, (1, 10)), ((0, 9, 4), 9, (8, 9))])
def test_windows(args, value, window):
    assert IntRange("k", *args).window(value) == window


@given(st.integers(-50, 50), st.integers(0, 100), st.integers(1, 20), st.integers(-100, 200))
def test_windows_equal_the_list_of_windows(start, size, interval, value):
    end = start + size
    listed = [(low, min(low + interval - 1, end)) for low in range(start, end + 1, interval)]
    want = next((w for w in listed if w[0] <= value <= w[1]), (start, end))
    assert IntRange("k", start, end, interval).window(value) == want


@pytest.mark.parametrize(("scheme", "value", "suffix"), [
    (Hour("h"), dt.datetime(2020, 1, 2, 3), "$2020010203"), (Day("d"), DAY, "$20200102"), (Month("m"), YearMonth(2020, 1), "$202001"), (IntRange("k"), 7, "$7"), (Sharded(), DAY, "_20200102"),
])
def test_suffixes(scheme, value, suffix):
    t = TableRef(TableId.local("tt"), scheme)
    p = t.partition(value)
    assert p.table_id.table == "tt" + suffix
    assert scheme.parse(suffix[1:]) == value


def test_partition_values_are_checked():
    with pytest.raises(TypeError):
        table("tt").partition(5)
    with pytest.raises(TypeError):
        table("tt").partition(dt.datetime(2020, 1, 2))
    with pytest.raises(TypeError, match="no partitions"):
        table("tt").unpartitioned.partition(DAY)
    with pytest.raises(ValueError):
        TableRef(TableId.local("tt_"), Sharded()).partition(DAY)


def test_order_and_union_rules():
    a, b = table("aa"), table("bb", IntRange("x", 0, 100, 10))
    days = [a.partition(dt.date(2020, 1, k)) for k in (1, 3, 2, 3)]
    assert [p.value.day for p in newest_first(days)] == [3, 3, 2, 1]
    sql = frag("{p}", p=[b.partition(5), *days]).sql
    assert sql == (
        "(SELECT * FROM `my_project__ds`.`aa` WHERE `d` IN (DATE'2020-01-03', DATE'2020-01-02', DATE'2020-01-01') UNION ALL "
        "SELECT * FROM `my_project__ds`.`bb` WHERE (`x` BETWEEN 0L AND 9L))"
    )
    with pytest.raises(ValueError, match="no partitions"):
        frag("{p}", p=[]).sql  # noqa: B018
    with pytest.raises(TypeError, match="partitioned"):
        frag("{p}", p=a)


def test_union_of_scans_is_scan_of_union(spark, sf):
    from quillspark.queries.base import events_by_day, view

    t = view(events_by_day(spark, sf), "test_events", Day("d"))
    ps = [t.partition(dt.date(2024, 1, k)) for k in (3, 4, 4, 9)]
    whole = scan_partitions(spark, ps).count()
    assert whole == sum(scan_partitions(spark, [p]).count() for p in set(ps)) > 0
    assert whole == frag("SELECT * FROM {ps}", ps=ps).run(spark).count()


def test_start_bounds():
    s = Start(dt.date(2020, 3, 4))
    assert s.for_scheme(Hour("h")).value == dt.datetime(2020, 3, 4)
    assert s.for_scheme(Month("m")).value == YearMonth(2020, 3)
    assert s.for_scheme(IntRange("k")).value is None
    assert Start(9).admits(10) and not Start(10).admits(9)


def udf(name, body, *names):
    return Udf(name, tuple(Param(n, LONG) for n in names), body, LONG)


def test_functions_are_collected_deepest_first(spark):
    cc = udf("cc", frag("x + 1"), "x")
    bb = udf("bb", frag("x * 10"), "x")
    aa = udf("aa", frag("{b} + {c}", b=bb(frag("x")), c=cc(frag("y"))), "x", "y")
    q = frag("SELECT {v} AS v", v=aa(2, 3))
    assert [u.name for u in q.temporary_functions()] == ["bb", "cc", "aa"]
    assert q.script[0] == "CREATE OR REPLACE TEMPORARY FUNCTION `bb`(`x` bigint) RETURNS bigint RETURN x * 10"
    assert q.run(spark).first()[0] == 24
    with pytest.raises(TypeError, match="takes 2"):
        aa(1)
    assert frag("a{x}", x=1) == frag("a{y}", y=1) and len({frag("q"), Frag(("q",))}) == 1


def test_python_body_and_persistent(spark):
    double = Udf("quill_py", (Param("x", LONG),), lambda x: None if x is None else x * 2, LONG)
    assert frag("SELECT {v} AS v", v=double(21)).run(spark).first()[0] == 42
    from quillspark.ids import DatasetRef, ProjectId

    kept = Udf("kept", (Param("x", LONG),), frag("x + 1"), LONG, DatasetRef(ProjectId("my-project"), "ds"))
    assert not kept.temporary and kept.as_temporary().temporary
    assert frag("{v}", v=kept(1)).sql == "`my_project__ds`.`kept`(1L)"
    assert Udf("elsewhere", (), None, LONG)().sql == "`elsewhere`()"


def test_lineage():
    base, other = table("base"), table("other")
    v = View(TableId.of("my-project", "ds", "vv"), Day("d"), query=frag("SELECT * FROM {a} JOIN {b} USING (x)", a=base.unpartitioned, b=other.partition(dt.date(2019, 1, 1))))
    q = frag("SELECT * FROM {v}", v=v.partition(DAY))
    assert [t.id.table for t in q.tables()] == ["base", "other"]
    assert q.tables(expand_views=False) == [v]
    got = q.partitions()
    assert [(p.table.id.table, p.value) for p in got] == [("base", DAY), ("other", dt.date(2019, 1, 1))]
    f = Tvf("ff", (Param("x", LONG),), frag("SELECT * FROM {a}", a=base.whole_table), base.schema)
    assert [t.id.table for t in frag("SELECT * FROM {f}", f=f(1)).tables()] == ["base"]


def test_fills_are_read_from_their_partition():
    dest, source = table("dest"), table("source")
    filled = FilledTable("job", dest, lambda d: frag("SELECT * FROM {p}", p=source.partition(d)))
    q = frag("SELECT * FROM {f}", f=[filled.with_date(DAY), filled.with_date(dt.date(2020, 1, 3))])
    assert "IN (DATE'2020-01-03', DATE'2020-01-02')" in q.sql
    assert {p.table.id.table for p in q.partitions()} == {"dest"}


def test_required_partition_filter():
    t = table("strict", options=TableOptions(partition_filter_required=True))
    assert check_partition_filters(frag("SELECT * FROM {t}", t=t.whole_table))
    assert not check_partition_filters(frag("SELECT * FROM {t}", t=t.partition(DAY)))
    assert joined(["a", 1]).sql == "'a', 1L"
