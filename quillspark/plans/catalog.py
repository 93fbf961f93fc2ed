"""Datasets, tables, views and routines in Spark's catalog.

Definitions are kept as JSON in the properties of tables and views, so that what Spark
has no place for (labels, policy tags, schemes, options) is read back as it was. Those of
routines are kept as JSON files in the folder of their database, so that another session
finds them. Where a table's real columns are not those of its definition, the real ones
are given.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from quillspark.fragment import Frag
from quillspark.functions.routines import Param, Tvf, Udf
from quillspark.ids import DatasetRef, ProjectId, TableId, TableLabels, quote
from quillspark.literals import string
from quillspark.partition import Day, Hour, IntRange, Month, NotPartitioned, Scheme, Sharded
from quillspark.tables import Definition, MaterializedView, Table, TableOptions, View
from quillspark.types import Mode, Schema, Type, TypeOf, comment, type_of

_SCHEMES = {c.__name__: c for c in (Hour, Day, Month, IntRange, Sharded, NotPartitioned)}
_PROPERTY = "quill.definition"


def scheme_to_json(s: Scheme) -> dict:
    return {"kind": type(s).__name__, **{k: v for k, v in vars(s).items()}}


def scheme_from_json(x: dict) -> Scheme:
    kind = x.get("kind")
    if kind not in _SCHEMES:
        raise TypeError(f"partitioning {kind} is not supported")
    return _SCHEMES[kind](**{k: v for k, v in x.items() if k != "kind"})


def to_json(d: Definition) -> dict:
    out = {
        "kind": type(d).__name__, "table": d.id.table, "schema": d.schema.to_json(), "partitioning": scheme_to_json(d.partitioning),
        "description": d.description, "labels": dict(d.labels),
    }
    if isinstance(d, Table):
        out |= {"clustering": list(d.clustering), "options": vars(d.options)}
    if isinstance(d, (View, MaterializedView)):
        out["query"] = d.query.sql
        out["functions"] = [u.create_sql() for u in d.query.temporary_functions()]
    if isinstance(d, MaterializedView):
        out |= {"enable_refresh": d.enable_refresh, "refresh_interval_ms": d.refresh_interval_ms, "options": vars(d.options)}
    return out


def from_json(dataset: DatasetRef | None, x: dict) -> Definition:
    common = {
        "id": TableId(dataset, x["table"]), "partitioning": scheme_from_json(x["partitioning"]), "schema": Schema.from_json(x["schema"]),
        "description": x["description"], "labels": TableLabels(x["labels"]),
    }
    if x["kind"] == "Table":
        return Table(**common, clustering=tuple(x["clustering"]), options=TableOptions(**x["options"]))
    if x["kind"] == "View":
        return View(**common, query=Frag((x["query"],)))
    return MaterializedView(**common, query=Frag((x["query"],)), enable_refresh=x["enable_refresh"], refresh_interval_ms=x["refresh_interval_ms"], options=TableOptions(**x["options"]))


def _type_to_json(t: TypeOf) -> dict:
    return {"mode": t.mode.value, "type": t.type.value, "fields": [[n, _type_to_json(x)] for n, x in t.fields]}


def _type_from_json(x: dict) -> TypeOf:
    return TypeOf(Mode(x["mode"]), Type(x["type"]), tuple((n, _type_from_json(t)) for n, t in x["fields"]))


def routine_to_json(r: Udf | Tvf) -> dict:
    out = {"kind": type(r).__name__, "name": r.name, "params": [[p.name, p.type and _type_to_json(p.type)] for p in r.params]}
    if isinstance(r, Udf):
        return out | {"body": r.body.sql, "returns": _type_to_json(r.returns)}
    return out | {"query": r.query.sql, "schema": r.schema.to_json(), "description": r.description}


def routine_from_json(dataset: DatasetRef, x: dict) -> Udf | Tvf:
    params = tuple(Param(n, t and _type_from_json(t)) for n, t in x["params"])
    if x["kind"] == "Udf":
        return Udf(x["name"], params, Frag((x["body"],)), _type_from_json(x["returns"]), dataset)
    return Tvf(x["name"], params, Frag((x["query"],)), Schema.from_json(x["schema"]), dataset, x["description"])


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    # datasets

    def create_dataset(self, d: DatasetRef) -> None:
        properties = {"quill.project": str(d.project), "quill.dataset": d.dataset} | ({"quill.location": d.location} if d.location else {})
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote(d.database)} WITH DBPROPERTIES ({', '.join(f'{string(k)} = {string(v)}' for k, v in properties.items())})")

    def delete_dataset(self, d: DatasetRef, cascade: bool = True) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {quote(d.database)}{' CASCADE' if cascade else ''}")

    def dataset(self, d: DatasetRef) -> DatasetRef | None:
        return d if self.spark.catalog.databaseExists(d.database) else None

    def list_datasets(self, project: ProjectId) -> list[DatasetRef]:
        prefix = DatasetRef(project, "x").database[:-1]
        return [DatasetRef(project, x.name.removeprefix(prefix)) for x in self.spark.catalog.listDatabases() if x.name.startswith(prefix)]

    # tables

    def _properties(self, name: str) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}

    def _tagged(self, d: Definition) -> str:
        own = {_PROPERTY: json.dumps(to_json(d)), **{f"label.{k}": v for k, v in d.labels.items()}}
        return ", ".join(f"{string(k)} = {string(v)}" for k, v in own.items())

    def create_table(self, d: Definition, exist_ok: bool = False) -> None:
        if isinstance(d, View):
            self.create_view(d)
            return
        if isinstance(d, MaterializedView):
            self.refresh(d, force=True)
            return
        if isinstance(d.partitioning, Sharded):
            return  # each day's table is made when it is written
        column = d.partitioning.column
        by = f" PARTITIONED BY ({quote(column)})" if column else ""
        # Spark sorts by bucket; clustering without bucketing stays in the definition
        self.spark.sql(f"CREATE TABLE {'IF NOT EXISTS ' if exist_ok else ''}{d.id.sql} ({d.schema.ddl()}) USING parquet{by}{comment(d.description)} TBLPROPERTIES ({self._tagged(d)})")

    def create_view(self, v: View) -> None:
        """Temporary functions of the query are put in as they are; a view in the catalog cannot use them."""
        if v.id.dataset is None:
            v.query.run(self.spark).createOrReplaceTempView(v.id.spark_name)
            return
        if v.query.temporary_functions():
            raise TypeError(f"{v.id} is persistent and cannot use temporary functions")
        columns = ", ".join(f"{quote(f.name)}{comment(f.description)}" for f in v.schema)
        self.spark.sql(f"CREATE OR REPLACE VIEW {v.id.sql}{f' ({columns})' if columns else ''}{comment(v.description)} TBLPROPERTIES ({self._tagged(v)}) AS {v.query.sql}")

    def refresh(self, mv: MaterializedView, force: bool = False) -> bool:
        """Make the result anew where it is missing or older than the interval; whether it was made."""
        name = mv.id.sql
        there = self.spark.catalog.tableExists(name)
        if there and not force:
            made = int(self._properties(name).get("quill.refreshed", "0"))
            if not mv.enable_refresh or time.time() * 1000 - made < mv.refresh_interval_ms:
                return False
        own = uuid.uuid4().hex
        staging, before = (mv.id.with_table(f"{mv.id.table}__{what}_{own}").sql for what in ("refreshing", "before"))
        writer = mv.query.run(self.spark).write
        (writer.partitionBy(mv.partitioning.column) if mv.partitioning.column else writer).saveAsTable(staging)
        self.spark.sql(f"ALTER TABLE {staging} SET TBLPROPERTIES ({self._tagged(mv)}, 'quill.refreshed' = '{int(time.time() * 1000)}')")
        # the old result goes only when the new one has its name
        if there:
            self.spark.sql(f"ALTER TABLE {name} RENAME TO {before}")
        try:
            self.spark.sql(f"ALTER TABLE {staging} RENAME TO {name}")
        except Exception:
            if there:
                self.spark.sql(f"ALTER TABLE {before} RENAME TO {name}")
            raise
        if there:
            self.spark.sql(f"DROP TABLE IF EXISTS {before}")
        return True

    def table(self, id: TableId) -> Definition | None:
        if not self.spark.catalog.tableExists(id.sql):
            return None
        found = self._properties(id.sql).get(_PROPERTY)
        if found is not None:
            defined = replace(from_json(id.dataset, json.loads(found)), id=id)
            return self._as_it_is(defined) if isinstance(defined, Table) else defined
        frame = self.spark.table(id.sql)
        column = next((c.name for c in self.spark.catalog.listColumns(id.sql) if c.isPartition), None)
        kind = dict(frame.dtypes).get(column)
        scheme = Day(column) if kind == "date" else Hour(column) if kind == "timestamp_ntz" else IntRange(column) if kind == "bigint" else NotPartitioned()
        return Table(id, scheme, Schema.from_spark(frame.schema))

    def _as_it_is(self, d: Table) -> Table:
        """The definition, with the real columns where these are others."""
        real, wanted = self.spark.table(d.id.sql).schema, d.schema.to_spark()
        if {f.name: f.dataType.simpleString() for f in real} == {f.name: f.dataType.simpleString() for f in wanted}:
            return d
        order = {n: k for k, n in enumerate(d.schema.names)}
        fields = sorted(Schema.from_spark(real), key=lambda f: order.get(f.name, len(order)))
        kept = {f.name: f for f in d.schema if f.name in real.names and f.to_spark().dataType.simpleString() == real[f.name].dataType.simpleString()}
        return replace(d, schema=Schema(kept.get(f.name, f) for f in fields))

    def _widen(self, d: Table) -> None:
        """Give the table the columns of ``d``, and the parts of structs. Files without them read as null."""
        real, wanted = self.spark.table(d.id.sql).schema, d.schema.to_spark()
        new = [f for f in d.schema if f.name not in real.names]
        if new:
            self.spark.sql(f"ALTER TABLE {d.id.sql} ADD COLUMNS ({', '.join(f'{quote(f.name)} {type_of(f).ddl()}{comment(f.description)}' for f in new)})")
        if not any(f.name in real.names and f.dataType.simpleString() != real[f.name].dataType.simpleString() for f in wanted):
            return
        # SQL has no statement for a part of a struct in Spark's own tables; the catalog's schema is set, and no data is touched
        state, column = self.spark._jsparkSession.sessionState(), d.partitioning.column
        data = [f for f in self.spark.table(d.id.sql).schema if f.name != column]
        data = T.StructType([T.StructField(f.name, wanted[f.name].dataType, True, f.metadata) for f in data])
        name = state.sqlParser().parseTableIdentifier(d.id.sql)
        state.catalog().alterTableDataSchema(name, self.spark._jsparkSession.parseDataType(data.json()))
        self.spark.catalog.refreshTable(d.id.sql)

    def update_table(self, d: Table) -> None:
        """Add new columns and parts of structs, and set description, labels and options; labels that are gone are unset."""
        self._widen(d)
        gone = [k for k in self._properties(d.id.sql) if k.startswith("label.") and k.removeprefix("label.") not in d.labels]
        if gone:
            self.spark.sql(f"ALTER TABLE {d.id.sql} UNSET TBLPROPERTIES IF EXISTS ({', '.join(map(string, gone))})")
        self.spark.sql(f"ALTER TABLE {d.id.sql} SET TBLPROPERTIES ({self._tagged(d)})")
        self.spark.sql(f"COMMENT ON TABLE {d.id.sql} IS {string(d.description) if d.description else 'NULL'}")

    def delete_table(self, id: TableId) -> None:
        found = self.table(id)
        self.spark.sql(f"DROP {'VIEW' if isinstance(found, View) else 'TABLE'} IF EXISTS {id.sql}")

    def list_tables(self, d: DatasetRef) -> list[TableId]:
        return [TableId(d, r["tableName"]) for r in self.spark.sql(f"SHOW TABLES IN {quote(d.database)}").collect() if not r["isTemporary"]]

    # routines; Spark keeps them, and files beside them keep what it cannot give back

    def _routine_file(self, dataset: DatasetRef, name: str):
        where = self.spark.sql(f"DESCRIBE DATABASE {quote(dataset.database)}").where("info_name = 'Location'").first()[1]
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_quill_routines/{name}.json")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def create_routine(self, r: Udf | Tvf) -> None:
        r.register(self.spark)
        if r.dataset is None:
            return
        path, files = self._routine_file(r.dataset, r.name)
        staged = path.suffix(f".{uuid.uuid4().hex}")
        out = files.create(staged, True)
        out.write(bytearray(json.dumps(routine_to_json(r)).encode()))
        out.close()
        files.delete(path, False)
        if not files.rename(staged, path):
            raise OSError(f"cannot write {path}")

    update_routine = create_routine

    def routine(self, name: str, dataset: DatasetRef) -> Udf | Tvf | None:
        """As it was made, in whatever session; None where Spark has no such function."""
        if self.dataset(dataset) is None or name not in self.list_routines(dataset):
            return None
        path, files = self._routine_file(dataset, name)
        if not files.exists(path):
            return None
        text = self.spark.read.text(path.toString(), wholetext=True).first()[0]
        return routine_from_json(dataset, json.loads(text))

    def delete_routine(self, name: str, dataset: DatasetRef) -> None:
        self.spark.sql(f"DROP FUNCTION IF EXISTS {quote(dataset.database)}.{quote(name)}")
        path, files = self._routine_file(dataset, name)
        files.delete(path, False)

    def list_routines(self, dataset: DatasetRef) -> list[str]:
        rows = self.spark.sql(f"SHOW USER FUNCTIONS IN {quote(dataset.database)}").collect()
        prefix = f"{dataset.database}."
        return sorted(r[0].removeprefix("spark_catalog.").removeprefix(prefix) for r in rows if prefix in r[0])
