"""Validated identifiers: columns, projects, datasets, tables, labels, jobs."""

from __future__ import annotations

import re
import urllib.parse
from dataclasses import dataclass

from quillspark.errors import InvalidId

# Words that cannot stand first in a path without quotes.
RESERVED = frozenset(
    """ALL AND ANY ARRAY AS ASC ASSERT_ROWS_MODIFIED AT BETWEEN BY CASE CAST COLLATE CONTAINS CREATE CROSS CUBE CURRENT DEFAULT
    DEFINE DESC DISTINCT ELSE END ENUM ESCAPE EXCEPT EXCLUDE EXISTS EXTRACT FALSE FETCH FOLLOWING FOR FROM FULL GROUP GROUPING
    GROUPS HASH HAVING IF IGNORE IN INNER INTERSECT INTERVAL INTO IS JOIN LATERAL LEFT LIKE LIMIT LOOKUP MERGE NATURAL NEW NO NOT
    NULL NULLS OF ON OR ORDER OUTER OVER PARTITION PRECEDING PROTO QUALIFY RANGE RECURSIVE RESPECT RIGHT ROLLUP ROWS SELECT SET SOME
    STRUCT TABLESAMPLE THEN TO TREAT TRUE UNBOUNDED UNION UNNEST USING WHEN WHERE WINDOW WITH WITHIN""".split()
)

_PART = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|`[^`]+`")
_TABLE = re.compile(r"\w[\w_ *$-]{1,1023}")
_DATASET = re.compile(r"[a-zA-Z0-9_]{1,1024}")
_PROJECT = re.compile(r"[a-z][a-z0-9-]{5,29}(?<!-)")


def quote(part: str) -> str:
    """A part of a name, quoted for Spark SQL."""
    return "`" + part.replace("`", "``") + "`"


@dataclass(frozen=True, order=True)
class Ident:
    """A column or a path into it."""

    value: str

    def __post_init__(self):
        parts = re.findall(r"`[^`]*`|[^.`]+|(?<=\.)(?=\.)|^(?=\.)|(?<=\.)$", self.value)
        if not parts or ".".join(parts) != self.value or not all(_PART.fullmatch(p) for p in parts):
            raise InvalidId(f"'{self.value}' is not a column or a path of columns")
        if parts[0].upper() in RESERVED:
            raise InvalidId(f"'{parts[0]}' is a reserved word")

    @property
    def parts(self) -> list[str]:
        return [p.strip("`") for p in re.findall(r"`[^`]*`|[^.`]+", self.value)]

    @property
    def sql(self) -> str:
        return ".".join(quote(p) for p in self.parts)

    def __str__(self) -> str:
        return self.value


@dataclass(frozen=True, order=True)
class ProjectId:
    value: str

    def __post_init__(self):
        if not _PROJECT.fullmatch(self.value):
            raise InvalidId(f"'{self.value}': a project has 6 to 30 lower-case letters, digits or hyphens, begins with a letter and does not end in a hyphen")

    def __str__(self) -> str:
        return self.value


@dataclass(frozen=True, order=True)
class DatasetRef:
    project: ProjectId
    dataset: str
    location: str | None = None

    def __post_init__(self):
        if not _DATASET.fullmatch(self.dataset):
            raise InvalidId(f"'{self.dataset}': a dataset has 1 to 1024 letters, digits or underscores")

    @property
    def database(self) -> str:
        """Its namespace in Spark's catalog."""
        return f"{self.project.value.replace('-', '_')}__{self.dataset}"

    def __str__(self) -> str:
        return f"{self.project}.{self.dataset}"


@dataclass(frozen=True, order=True)
class TableId:
    """A table in a dataset or, without one, a temporary view of the session."""

    dataset: DatasetRef | None
    table: str

    def __post_init__(self):
        if not _TABLE.fullmatch(self.table):
            raise InvalidId(f"'{self.table}': a table has 2 to 1024 word characters, blanks, '*', '$' or '-'")

    @classmethod
    def of(cls, project: str, dataset: str, table: str) -> TableId:
        return cls(DatasetRef(ProjectId(project), dataset), table)

    @classmethod
    def local(cls, table: str) -> TableId:
        return cls(None, table)

    @classmethod
    def parse(cls, text: str) -> TableId:
        """``project.dataset.table`` or ``projects/p/datasets/d/tables/t``."""
        if m := re.fullmatch(r"projects/([^/]+)/datasets/([^/]+)/tables/([^/]+)", text):
            return cls.of(*(urllib.parse.unquote(x) for x in m.groups()))
        parts = text.strip("`").split(".", 2)
        if len(parts) == 1:
            return cls.local(parts[0])
        if len(parts) != 3:
            raise InvalidId(f"'{text}' is not project.dataset.table")
        return cls.of(*parts)

    @property
    def spark_name(self) -> str:
        """Its name among Spark's tables, which allow word characters only."""
        return self.table if self.dataset is None else re.sub(r"\W", "_", self.table)

    @property
    def sql(self) -> str:
        own = quote(self.spark_name)
        return own if self.dataset is None else f"{quote(self.dataset.database)}.{own}"

    def with_table(self, table: str) -> TableId:
        return TableId(self.dataset, table)

    def __str__(self) -> str:
        return self.table if self.dataset is None else f"{self.dataset}.{self.table}"


def label_problems(key: str | None, value: str | None) -> list[str]:
    """What is wrong with a label; both parts are checked."""
    found = []
    if key is not None:
        if not key:
            found.append("label key is empty")
        elif not key[0].islower():
            found.append(f"label key {key} must start with a lower-case letter")
        if len(key) > 63:
            found.append(f"label key {key} is over 63 characters")
        if not all(c.islower() or c.isdigit() or c in "-_" for c in key):
            found.append(f"label key {key} can only contain lower-case letters, digits, _ and -")
    if value is not None:
        if len(value) > 63:
            found.append(f"label value {value} is over 63 characters")
        if not all(c.islower() or c.isdigit() or c in "-_" for c in value):
            found.append(f"label value {value} can only contain lower-case letters, digits, _ and -")
    return found


class Labels(dict):
    """Validated labels, in the order of their keys."""

    def __init__(self, *args, **kwargs):
        given = dict(*args, **kwargs)
        if problems := [p for k, v in given.items() for p in label_problems(k, v)]:
            raise InvalidId(*problems)
        super().__init__(sorted(given.items()))


class TableLabels(Labels):
    """On a conflict, the right side wins."""

    def __or__(self, other):
        return TableLabels({**self, **other})


class JobLabels(Labels):
    """On a conflict, the left side wins."""

    def __or__(self, other):
        return JobLabels({**other, **self})


def safe_label(text: str) -> str:
    """Any text made into a label value."""
    return re.sub(r"\W", "_", text.strip()[:63].lower())


def job_name(text: str) -> str:
    """A name for a job: word characters, at most 1024."""
    return re.sub(r"[^A-Za-z0-9_]", "", text.replace("<lambda>", "").replace("<locals>.", "").replace(".", "_"))[:1024]
