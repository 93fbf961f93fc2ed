"""Temporary tables, and copies of whole datasets."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from quillspark.ids import DatasetRef, TableId
from quillspark.tables import Table

EXPIRY_S = 3600


def create_temporary(spark: SparkSession, table: Table, dataset: DatasetRef, expiry_s: int = EXPIRY_S) -> Table:
    """A new table like ``table``, in ``dataset``, under a name of its own, with the time when it may go."""
    from quillspark.plans.catalog import Catalog

    own = replace(table, id=TableId(dataset, f"{table.id.table}_{uuid.uuid4().hex}"))
    catalog = Catalog(spark)
    catalog.create_table(own)
    spark.sql(f"ALTER TABLE {own.id.sql} SET TBLPROPERTIES ('quill.expires' = '{int(time.time()) + expiry_s}')")
    return own


@contextmanager
def temporary_table(spark: SparkSession, table: Table, dataset: DatasetRef, expiry_s: int = EXPIRY_S):
    """A temporary table that is dropped at the end."""
    own = create_temporary(spark, table, dataset, expiry_s)
    try:
        yield own
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {own.id.sql}")


def drop_expired(spark: SparkSession, dataset: DatasetRef, now: float | None = None) -> list[str]:
    """Drop temporary tables whose time is over."""
    gone = []
    for row in spark.sql(f"SHOW TABLES IN `{dataset.database}`").collect():
        name = f"`{dataset.database}`.`{row['tableName']}`"
        if row["isTemporary"]:
            continue
        found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        if "quill.expires" in found and int(found["quill.expires"]) <= (time.time() if now is None else now):
            spark.sql(f"DROP TABLE {name}")
            gone.append(row["tableName"])
    return gone


@dataclass
class CopyStatus:
    """How far a copy of a dataset is."""

    source: DatasetRef
    target: DatasetRef
    state: str = "PENDING"
    copied: list[str] = field(default_factory=list)
    error: str | None = None


def copy_dataset(spark: SparkSession, source: DatasetRef, target: DatasetRef, overwrite: bool = True) -> CopyStatus:
    """Copy all tables, with their partitioning and properties."""
    status = CopyStatus(source, target, "RUNNING")
    try:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{target.database}`")
        for row in spark.sql(f"SHOW TABLES IN `{source.database}`").collect():
            if row["isTemporary"]:
                continue
            a, b = f"`{source.database}`.`{row['tableName']}`", f"`{target.database}`.`{row['tableName']}`"
            if overwrite:
                spark.sql(f"DROP TABLE IF EXISTS {b}")
            if not spark.catalog.tableExists(b):
                spark.sql(f"CREATE TABLE {b} LIKE {a}")
                kept = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {a}").collect() if r["key"].startswith("quill.")}
                for k, v in kept.items():
                    from quillspark.literals import string

                    spark.sql(f"ALTER TABLE {b} SET TBLPROPERTIES ({string(k)} = {string(v)})")
                spark.table(a).write.insertInto(b)
            status.copied.append(row["tableName"])
        status.state = "SUCCEEDED"
    except Exception as e:
        status.state, status.error = "FAILED", str(e)
    return status
