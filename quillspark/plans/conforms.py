"""Whether one schema serves where another is wanted. Each check lists what is wrong."""

from __future__ import annotations

from quillspark.types import Field, Mode, Schema, Type, TypeOf


def _repeated(f: Field) -> bool:
    return f.mode is Mode.REPEATED


def only_types(given: Schema, wanted: Schema) -> list[str]:
    """By position: names, types and whether repeated. Given columns beyond those wanted are let be."""
    return _by_position(list(given), list(wanted), "")


def _by_position(given: list[Field], wanted: list[Field], path: str) -> list[str]:
    out = []
    for k, want in enumerate(wanted):
        if k >= len(given):
            out.append(f"Expected field `{path}{want.name}` at 0-based index {k}")
            continue
        out += _compare(given[k], want, path, _by_position)
    return out


def _compare(given: Field, want: Field, path: str, inner, names: bool = True) -> list[str]:
    out = []
    if names and given.name != want.name:
        out.append(f"Expected field `{path}{want.name}`, got field `{path}{given.name}`")
    if given.type is not want.type:
        out.append(f"Expected field `{path}{want.name}` to have type {want.type.value}, got {given.type.value}")
    elif _repeated(given) != _repeated(want):
        out.append(f"Expected field `{path}{want.name}` to have mode {want.mode.value}, got {given.mode.value}")
    elif given.fields and want.type in (Type.STRUCT, Type.ARRAY):
        out += inner(list(given.fields), list(want.fields), f"{path}{want.name}.")
    return out


def only_types_of(given: TypeOf, wanted: TypeOf) -> list[str]:
    """As ``only_types``, without names."""

    def strip(t: TypeOf, name: str) -> Field:
        return Field(name, t.type, t.mode, fields=tuple(strip(x, f"_{k}") for k, (_, x) in enumerate(t.fields)))

    return _compare(strip(given, "value"), strip(wanted, "value"), "", _by_position)


def types_and_names(given: Schema, wanted: Schema) -> list[str]:
    """By name, in any order."""
    return _by_name(list(given), list(wanted), "")


def _by_name(given: list[Field], wanted: list[Field], path: str) -> list[str]:
    have, out = {f.name: f for f in given}, []
    for want in wanted:
        if want.name not in have:
            out.append(f"Expected field `{path}{want.name}` to be part of [{', '.join(sorted(have))}]")
        else:
            out += _compare(have[want.name], want, path, _by_name)
    return out


def field_counts(given: Schema, wanted: Schema) -> list[str]:
    """Equal counts of fields at every level."""

    def count(a: list[Field], b: list[Field], at: str) -> list[str]:
        out = [f"At {at}: expected {len(b)} fields, got {len(a)}"] if len(a) != len(b) else []
        for x, y in zip(a, b, strict=False):
            if y.type is Type.STRUCT and x.fields:
                out += count(list(x.fields), list(y.fields), y.name if at == "root" else f"{at}.{y.name}")
        return out

    return count(list(given), list(wanted), "root")


def exact(given: Schema, wanted: Schema) -> list[str]:
    return only_types(given, wanted) + field_counts(given, wanted)
