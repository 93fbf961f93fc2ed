from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators.projection import Drop, Keep, Rename, project
from quillspark.plans import conforms
from quillspark.types import Field, Mode, Schema, Type, type_of_schema

NAMES = st.sampled_from([f"c{k}" for k in range(8)])
LEAF = st.builds(Field, NAMES, st.sampled_from([Type.STRING, Type.INT64, Type.DATE, Type.NUMERIC]), st.sampled_from(Mode))


def named_apart(fields):
    return list({f.name: f for f in fields}.values())


STRUCT = st.recursive(LEAF, lambda inner: st.builds(lambda n, m, fs: Field(n, Type.STRUCT, m, fields=tuple(named_apart(fs))), NAMES, st.sampled_from(Mode), st.lists(inner, min_size=1, max_size=4)), max_leaves=8)
SCHEMAS = st.lists(STRUCT, min_size=1, max_size=5).map(lambda fs: Schema(tuple(named_apart(fs))))


@settings(max_examples=150, deadline=None)
@given(SCHEMAS)
def test_a_schema_conforms_to_itself(schema):
    assert conforms.exact(schema, schema) == [] and conforms.types_and_names(schema, schema) == []
    assert Schema.from_json(schema.to_json()) == schema
    assert conforms.types_and_names(Schema(tuple(reversed(schema.fields))), schema) == []
    assert type_of_schema(schema) == type_of_schema(Schema.from_json(schema.to_json()))
    assert not any(f.has_required() for f in schema.recursively_nullable())


@settings(max_examples=100, deadline=None)
@given(SCHEMAS, SCHEMAS)
def test_conformance_of_extensions(a, b):
    wider = Schema((*a.fields, *(f.with_name(f"more_{f.name}") for f in b)))
    assert conforms.only_types(wider, a) == []
    assert len(conforms.only_types(a, wider)) == len(b) and len(conforms.field_counts(wider, a)) == 1


@settings(max_examples=40, deadline=None)
@given(SCHEMAS)
def test_projected_fields(spark, schema):
    f = Field("root", Type.STRUCT, fields=schema.fields)
    kept = project(f, lambda x: Keep())
    singles = any(x.mode is Mode.REPEATED and x.type is Type.STRUCT and len(x.fields) == 1 for x in every(f))
    assert kept is not None and (singles or kept[1] == f)
    df = spark.createDataFrame([], Schema.of(f).to_spark())
    for op in (lambda x: Keep(), lambda x: Rename(x.name + "_r"), lambda x: Drop() if x.name in ("c0", "c3") else Keep()):
        if (out := project(f, op)) is not None:
            assert df.select(out[0]).schema[0].dataType.simpleString() == out[1].to_spark().dataType.simpleString()


def every(f):
    return [f, *(y for x in f.fields for y in every(x))]
