import random

import pytest
from pyspark.sql import functions as F

from quillspark.errors import SchemaMismatch
from quillspark.functions.hashing import hashed, hashed_value
from quillspark.operators.merge import merge_keys, upsert
from quillspark.operators.projection import Drop, Flatten, Keep, Rename, project
from quillspark.partition import Day, IntRange, Month
from quillspark.types import Field, Mode, Type

SCHEMA = "k1 long, k2 string, v string"


@pytest.mark.parametrize("seed", range(3))
def test_merge_against_a_model(spark, seed):
    rng = random.Random(seed)

    def rows(n, word):
        keys = {(rng.choice([None, *range(12)]), rng.choice([None, "a", "b"])) for _ in range(n)}
        return [(*k, rng.choice([None, f"{word}{j}"])) for j, k in enumerate(keys)]

    target, source = rows(20, "t"), rows(15, "s")
    want = {(a, b): v for a, b, v in target} | {(a, b): v for a, b, v in source}
    s, t = spark.createDataFrame(source, SCHEMA), spark.createDataFrame(target, SCHEMA)
    merged = upsert(s, t, ["k1", "k2"])
    got = {(r.k1, r.k2): r.v for r in merged.collect()}
    assert got == want and merged.count() == len(want)
    again = upsert(s, merged, ["k1", "k2"])
    assert {(r.k1, r.k2): r.v for r in again.collect()} == want


def test_merge_edges(spark):
    t = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "b", "z")], SCHEMA)
    s = spark.createDataFrame([(1, "a", "new")], SCHEMA)
    assert sorted(r.v for r in upsert(s, t, ["k1", "k2"]).collect()) == ["new", "new", "z"]
    everything = upsert(s, t, ["k1", "k2", "v"])
    assert everything.count() == 4
    with pytest.raises(Exception, match="several rows for .*k1.*1"):
        upsert(t, t, ["k1", "k2"]).collect()
    assert upsert(t, t, ["k1", "k2"], check=False).count() == 3
    with pytest.raises(SchemaMismatch):
        upsert(s.drop("v"), t, ["k1"])
    empty = t.limit(0)
    assert upsert(empty, t, ["k1"], check=False).count() == 3 and upsert(s, empty, ["k1"]).count() == 1
    assert merge_keys(["a"], Day("d")) == ["a", "d"] and merge_keys(["a"], Month("m")) == ["a"]


def test_merge_reads_each_side_once(spark, tmp_path):
    spark.range(50).selectExpr("id AS k", "string(id) AS v").write.parquet(str(tmp_path / "t"))
    spark.range(40, 60).selectExpr("id AS k", "string(-id) AS v").write.parquet(str(tmp_path / "s"))
    merged = upsert(spark.read.parquet(str(tmp_path / "s")), spark.read.parquet(str(tmp_path / "t")), ["k"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 2 and merged.count() == 60


def test_pruned_merge_keeps_null_partitions_right(spark):
    t = spark.createDataFrame([(1, None, "x"), (2, 5, "y"), (3, 6, "z")], "k long, p long, v string")
    s = spark.createDataFrame([(1, None, "new"), (4, 5, "w")], "k long, p long, v string")
    got = upsert(s, t, ["k"], IntRange("p"), prune=True)
    assert sorted((r.k, r.p or -1, r.v) for r in got.collect()) == [(1, -1, "new"), (2, 5, "y"), (4, 5, "w")]


FOO = Field.struct(
    "foo", Field("keep_me_1", Type.STRING), Field("drop_me", Type.STRING), Field("rename_me", Type.STRING),
    Field.struct("keep_struct", Field("one", Type.STRING), Field("two", Type.STRING)), Field.struct("flatten_struct", Field("one", Type.STRING), Field("two", Type.STRING)),
    Field.repeated_struct("items", Field("a", Type.INT64), Field("b", Type.INT64)),
)
OPS = {"drop_me": Drop(), "rename_me": Rename("renamed"), "flatten_struct": Flatten("f"), "b": Drop()}


def test_projection_type_is_the_frames(spark):
    rows = [(("k", "d", "r", ("1", "2"), ("3", "4"), [(1, 2), (3, 4)]),), (None,), (("k", None, None, None, None, []),), (("k", None, None, None, None, None),)]
    column, field = project(FOO, lambda f: OPS.get(f.name, Keep()))
    df = spark.createDataFrame(rows, "foo struct<keep_me_1:string,drop_me:string,rename_me:string,keep_struct:struct<one:string,two:string>,flatten_struct:struct<one:string,two:string>,items:array<struct<a:bigint,b:bigint>>>")
    got = df.select(column)
    assert [f.name for f in field.fields] == ["keep_me_1", "renamed", "keep_struct", "fOne", "fTwo", "items"]
    assert got.schema["foo"].dataType.simpleString() == field.to_spark().dataType.simpleString()
    out = [r.foo for r in got.collect()]
    assert out[0].asDict(recursive=True) == {"keep_me_1": "k", "renamed": "r", "keep_struct": {"one": "1", "two": "2"}, "fOne": "3", "fTwo": "4", "items": [1, 3]}
    assert out[1] is None and out[2]["items"] == [] and out[3]["items"] is None


def test_projection_edges():
    assert project(FOO, lambda f: Drop()) is None
    with pytest.raises(TypeError, match="flattened"):
        project(FOO, lambda f: Flatten())
    same = Field.struct("s", Field("a", Type.INT64, Mode.REQUIRED), Field("b", Type.DATE))
    from pyspark.sql import SparkSession

    assert SparkSession.getActiveSession() is not None
    assert project(same, lambda f: Keep())[1] == same


def test_hash_twins(spark):
    scheme = IntRange("p", 0, 20, 2)
    texts = [None, "", "a", "ø", *(f"{random.Random(k).getrandbits(128):032x}" for k in range(100))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashed(F.col("t"), scheme).alias("h")).collect()
    assert all(r.h == hashed_value(r.t, scheme) and 0 <= r.h < 20 for r in got)
