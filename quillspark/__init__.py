"""Typed tables, partitions, SQL fragments, merges, loads and deployment on PySpark."""

from quillspark.fragment import Frag, frag, joined
from quillspark.ids import DatasetRef, Ident, ProjectId, TableId
from quillspark.partition import Day, Hour, IntRange, Month, NotPartitioned, PartitionId, Sharded
from quillspark.tables import MaterializedView, Table, TableRef, View
from quillspark.types import Field, Mode, Schema, Type

__all__ = [
    "DatasetRef", "Day", "Field", "Frag", "Hour", "Ident", "IntRange", "MaterializedView", "Mode", "Month", "NotPartitioned",
    "PartitionId", "ProjectId", "Schema", "Sharded", "Table", "TableId", "TableRef", "Type", "View", "frag", "joined",
]
