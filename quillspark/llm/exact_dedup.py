"""Exact dedup by a log-structured merge index of digests.

Each task gathers digests in a memtable and flushes it, when full, as a run sorted by
digest: (digest, keep, n, ties), where ``keep`` is the identifier that stays, ``n`` the
rows and ``ties`` the rows of that identifier. Runs are Parquet files with Bloom filters
and least and greatest digests, by which ``Index.lookup`` skips those without a digest.
Generations of runs are listed in a manifest. Compaction merges the runs of a level into
one generation of the next, whose files hold ranges of digests that do not overlap, and
swaps the manifest at the end; a crash before leaves the old generations in force.

Decisions come from the index: a row's digest leads to the entry with the identifier
that stays and the size of the group. A filter of fixed size over the entries of several
rows picks the texts that are verified byte by byte; groups whose bytes differ under one
digest are split by their text.

A null text counts as empty. Of equal texts the row with the largest doc_id stays (or
the smallest: ``keep="min"``); a missing doc_id is kept only where the group has no
other, and each row is judged by its own text, so a text that shares its doc_id with
another is not dropped with it. Rows that repeat with their doc_id are one document:
``report`` gives all of them its decision, ``keep_one`` leaves one of them. An empty
table gives an empty result.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import all_of, cut, digest_of, files_at, free, remove, sent_if_few, shared_path
from quillspark.llm.filters import may_repeat

#: Distinct digests that a memtable holds before it is flushed.
MEMTABLE = 200_000
#: Generations of a level that are merged into one of the next.
FAN_OUT = 4
#: Stands for a missing doc_id in a run: it is kept last.
_NO_ID = {"max": -(1 << 63), "min": (1 << 63) - 1}
_RUN = "digest string, keep long, n long, ties long"

sha256_of = digest_of


def _merged(rows: pa.Table, keep: str) -> pa.Table:
    """One row for each digest, in order. ``rows``: digest, keep, n, ties."""
    order = "descending" if keep == "max" else "ascending"
    by_id = rows.group_by(["digest", "keep"]).aggregate([("n", "sum"), ("ties", "sum")])
    by_id = by_id.sort_by([("digest", "ascending"), ("keep", order)])
    best = by_id.group_by(["digest"], use_threads=False).aggregate([("keep", "first"), ("n_sum", "sum"), ("ties_sum", "first")])
    return pa.table({"digest": best["digest"], "keep": best["keep_first"], "n": best["n_sum_sum"], "ties": best["ties_sum_first"]}).sort_by("digest")


class Index:
    """Sorted runs of digests under ``path``, in levels."""

    def __init__(self, spark: SparkSession, path: str, keep: str = "max"):
        self.spark, self.path, self.keep = spark, path, keep

    # the manifest: numbered files, of which the last one counts

    def _last(self) -> tuple[int, list[dict]]:
        where, files = files_at(self.spark, f"{self.path}/manifest")
        names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
        last = max((int(x) for x in names if x.isdigit()), default=-1)
        if last < 0:
            return last, []
        text = self.spark.read.text(f"{self.path}/manifest/{last}", wholetext=True).first()[0]
        return last, json.loads(text)

    def generations(self) -> list[dict]:
        """(level, path) of those in force."""
        return self._last()[1]

    def _swap(self, generations: list[dict]) -> None:
        last, _ = self._last()
        where, files = files_at(self.spark, f"{self.path}/manifest/{last + 1}")
        staged, _ = files_at(self.spark, f"{self.path}/manifest/_{last + 1}")
        out = files.create(staged, True)
        out.writeBytes(json.dumps(generations))
        out.close()
        if not files.rename(staged, where):
            raise OSError(f"cannot write the manifest {where}")

    def _write(self, runs: DataFrame, level: int) -> dict:
        path = f"{self.path}/level-{level}/{uuid.uuid4().hex}"
        runs.write.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
        return {"level": level, "path": path}

    # writing

    def append(self, rows: DataFrame, memtable: int = MEMTABLE) -> None:
        """A generation of runs of ``rows`` (digest, doc_id)."""
        keep = self.keep

        def flushed(held: list[pa.RecordBatch]) -> pa.Table:
            return _merged(pa.Table.from_batches(held), keep)

        def runs(batches):
            held, size = [], 0
            for batch in batches:
                one = pa.array([1] * len(batch), pa.int64())
                held.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), one, one], ["digest", "keep", "n", "ties"]))
                size += len(batch)
                if size > memtable:
                    table = flushed(held)
                    held, size = table.to_batches(), len(table)
                    if size > memtable // 2:
                        yield from held
                        held, size = [], 0
            if held:
                yield from flushed(held).to_batches()

        given = rows.select("digest", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID[keep])).alias("keep"))
        made = self._write(given.mapInArrow(runs, _RUN), 0)
        self._swap([*self.generations(), made])

    def _entries(self, generations: list[dict]) -> DataFrame:
        """The runs of some generations merged by digest, in ranges of digests, sorted."""
        runs = self.spark.read.schema(_RUN).parquet(*[g["path"] for g in generations])
        best = F.max if self.keep == "max" else F.min
        # the best identifier, and its rows only: sorting by range gives each digest to one task, so this shuffles once
        ranged = runs.repartitionByRange("digest").groupBy("digest", "keep").agg(F.sum("n").alias("n"), F.sum("ties").alias("ties"))
        entries = ranged.groupBy("digest").agg(best(F.struct("keep", "ties")).alias("b"), F.sum("n").alias("n"))
        return entries.select("digest", "b.keep", "n", "b.ties").sortWithinPartitions("digest")

    def compact(self, everything: bool = False) -> None:
        """Merge each level that has ``FAN_OUT`` generations into the next; with ``everything``, all into one."""
        level = 0
        while True:
            have = self.generations()
            top = max((g["level"] for g in have), default=0)
            if everything:
                merged, level = (have, top + 1) if have else ([], 0)
            else:
                merged = [g for g in have if g["level"] == level]
                merged = merged if len(merged) >= FAN_OUT else []
            if merged:
                made = self._write(self._entries(merged), level if everything else level + 1)
                self._swap([g for g in have if g not in merged] + [made])
                for g in merged:
                    remove(self.spark, g["path"])
            if everything or level >= top:
                return
            level += 1

    # reading

    def entries(self) -> DataFrame:
        """(digest, keep, n, ties): one row for each digest."""
        have = self.generations()
        if len(have) == 1 and have[0]["level"]:
            return self.spark.read.schema(_RUN).parquet(have[0]["path"])
        if not have:
            return self.spark.createDataFrame([], _RUN)
        return self._entries(have)

    def lookup(self, digests: list[str]) -> DataFrame:
        """Rows of the runs for a few digests; files whose ranges and filters rule them out are skipped."""
        have = self.generations()
        if not have:
            return self.spark.createDataFrame([], _RUN)
        return self.spark.read.schema(_RUN).parquet(*[g["path"] for g in have]).where(F.col("digest").isin(digests))


def _decided(docs: DataFrame, keep: str, digest: Column | None, memtable: int, out: str) -> tuple[DataFrame, bool]:
    """``docs`` with ``out``: digest, and keep, n and ties of its group as the index has them; and whether any has ties."""
    spark = docs.sparkSession
    digest = digest_of(F.col("text")) if digest is None else digest
    given = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID[keep]))
    index = Index(spark, shared_path(spark, "digest-index"), keep)
    index.append(docs.select(digest.alias("digest"), "doc_id"), memtable)
    index.compact(everything=True)
    repeated = cut(index.entries().where("n > 1"))
    remove(spark, index.path)
    # texts that the index says repeat are verified: equal digests must have equal bytes
    may = may_repeat(repeated)
    hits = docs.select(digest.alias("digest"), F.coalesce("text", F.lit("")).alias("text"), given.alias("keep")).where(may(F.col("digest")))
    forms = hits.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
    unequal = cut(forms.groupBy("digest").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1").select("digest"))
    split = bool(unequal.take(1))
    equal = repeated.join(unequal, "digest", "left_anti") if split else repeated
    key, text, found = (free(docs, f"__quill_{x}") for x in ("key", "text", "found"))
    equal = cut(equal.select(F.col("digest").alias(key), F.struct("keep", "n", "ties").alias(found)))
    joined = docs.withColumn(out, digest).join(sent_if_few(equal), F.col(out) == F.col(key), "left").drop(key)
    ties = split or bool(repeated.where("ties > 1").take(1))
    if split:
        own = hits.join(unequal, "digest", "left_semi").groupBy("digest", "text", "keep").agg(F.count(F.lit(1)).alias("ties"))
        best = {"max": F.max, "min": F.min}[keep](F.struct("keep", "ties"))
        own = own.groupBy("digest", "text").agg(best.alias("b"), F.sum("ties").alias("n"))
        apart = free(docs, "__quill_apart")
        own = own.select(F.col("digest").alias(key), F.col("text").alias(text), F.struct("b.keep", "n", "b.ties").alias(apart))
        joined = joined.join(own, (F.col(out) == F.col(key)) & (F.coalesce("text", F.lit("")) == F.col(text)), "left").drop(key, text)
        joined = joined.withColumn(found, F.coalesce(apart, found)).drop(apart)
    kept = F.when(F.col(found).isNull(), F.col("doc_id").cast("long")).when(F.col(f"{found}.keep") != _NO_ID[keep], F.col(f"{found}.keep"))
    one = F.lit(1).cast("long")
    whole = F.struct(F.col(out).alias("digest"), kept.alias("keep"), F.coalesce(f"{found}.n", one).alias("n"), F.coalesce(f"{found}.ties", one).alias("ties"))
    return joined.select(*all_of(docs), whole.alias(out)), ties


def duplicates(docs: DataFrame, keep: str = "max", digest: Column | None = None, memtable: int = MEMTABLE) -> DataFrame:
    """(doc_id, digest, keep_id, group_size) of each row. ``digest``: SHA-256 of the text, unless given."""
    found, _ = _decided(docs.select("doc_id", "text"), keep, digest, memtable, "_copy")
    return found.select("doc_id", F.col("_copy.digest").alias("digest"), F.col("_copy.keep").alias("keep_id"), F.col("_copy.n").alias("group_size"))


def report(docs: DataFrame) -> DataFrame:
    found = duplicates(docs)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, keep: str = "max", digest: Column | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    out = free(docs, "__quill_copy")
    found, ties = _decided(docs, keep, digest, MEMTABLE, out)
    stay = found.where(F.col("doc_id").cast("long").eqNullSafe(F.col(f"{out}.keep")))
    if not ties:
        return stay.select(*all_of(docs))
    # rows that repeat with their doc_id: any one of them
    first = F.first(F.struct(*all_of(docs))).alias("row")
    tied = stay.where(F.col(f"{out}.ties") > 1).groupBy(F.col(f"{out}.digest").alias("digest"), F.col("text").alias("text")).agg(first)
    return stay.where(F.col(f"{out}.ties") == 1).select(*all_of(docs)).unionByName(tied.select("row.*"))
