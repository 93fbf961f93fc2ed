"""Python source for definitions that the catalog holds."""

from __future__ import annotations

import re

from quillspark.partition import NotPartitioned
from quillspark.tables import Definition, MaterializedView, Table, View
from quillspark.types import Field


def _name(d: Definition) -> str:
    return re.sub(r"\W", "_", d.id.table).upper()


def _field(f: Field) -> str:
    more = [f"Mode.{f.mode.name}"]
    if f.description:
        more.append(f"description={f.description!r}")
    if f.fields:
        more.append(f"fields=({''.join(_field(x) + ', ' for x in f.fields).rstrip()})")
    if f.policy_tags:
        more.append(f"policy_tags={f.policy_tags!r}")
    return f"Field({f.name!r}, Type.{f.type.name}, {', '.join(more)})"


def _id(d: Definition) -> str:
    return f"TableId.of({str(d.id.dataset.project)!r}, {d.id.dataset.dataset!r}, {d.id.table!r})" if d.id.dataset else f"TableId.local({d.id.table!r})"


def source(d: Definition) -> str:
    """A module with one definition."""
    lines = [
        "from quillspark import *", "from quillspark.fragment import Frag", "from quillspark.ids import TableLabels", "from quillspark.tables import MaterializedView, TableOptions", "",
        f"{_name(d)} = {type(d).__name__}(", f"    id={_id(d)},", f"    partitioning={d.partitioning!r},", "    schema=Schema.of(", *(f"        {_field(f)}," for f in d.schema), "    ),",
    ]
    if isinstance(d.partitioning, NotPartitioned):
        lines.remove(f"    partitioning={d.partitioning!r},")
    if d.description:
        lines.append(f"    description={d.description!r},")
    if d.labels:
        lines.append(f"    labels=TableLabels({dict(d.labels)!r}),")
    if isinstance(d, Table) and d.clustering:
        lines.append(f"    clustering={d.clustering!r},")
    if isinstance(d, (Table, MaterializedView)) and d.options != type(d.options)():
        lines.append(f"    options={d.options!r},")
    if isinstance(d, MaterializedView):
        lines += [f"    enable_refresh={d.enable_refresh!r},", f"    refresh_interval_ms={d.refresh_interval_ms!r},"]
    if isinstance(d, (View, MaterializedView)):
        lines.append(f"    query=Frag(({d.query.sql!r},)),")
    return "\n".join([*lines, ")", ""])
