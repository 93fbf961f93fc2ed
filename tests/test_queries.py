import glob
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    return round(float(x), 6) if isinstance(x, (float, Decimal)) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    order = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in order]) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    found = db.execute(ORACLES[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == order
    assert got == sorted(str([plain(r[cols.index(c)]) for c in order]) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["partition_date_single", "partition_date_multi", "partition_hour_single", "partition_hour_bucketed", "partition_month_single", "partition_multi_table_union"])
def test_partition_range_is_pushed_down(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    pushed = [x for x in plan.split("PushedFilters: [")[1:]]
    assert pushed and all("GreaterThanOrEqual(" in x.split("]")[0] and "LessThan(" in x.split("]")[0] for x in pushed)


def test_partition_filter_reaches_the_scan(spark, sf, tmp_path):
    import datetime as dt

    from quillspark import Day, frag
    from quillspark.queries.base import events_by_day, view

    events_by_day(spark, sf).write.partitionBy("d").parquet(str(tmp_path / "e"))
    t = view(spark.read.parquet(str(tmp_path / "e")), "test_pruned", Day("d"))
    days = [t.partition(dt.date(2024, 1, k)) for k in (3, 5)]
    plan = frag("SELECT event_id FROM {p}", p=days).run(spark)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [d" in plan and "ReadSchema: struct<event_id:bigint>" in plan
