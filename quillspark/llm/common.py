"""Helpers shared by the operators: durable cuts of lineage, Arrow batch size, ranks."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in one Arrow batch of texts. Texts can be long; a batch must stay small.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where it is unset, a folder of our own is
    used, which only a local master may do.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master != "local" and not (sc.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = sc.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder, so that lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` for what is computed within, and as they were afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_of(df: DataFrame) -> list[Column]:
    """Every column, whatever its name has in it."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def digest_of(text: Column) -> Column:
    """SHA-256 of a text in UTF-8, as hex; a null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def files_at(spark: SparkSession, path: str):
    """(path, file system) as Hadoop has them, so that any shared store will do."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, files = files_at(spark, path)
    files.delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positive_hash(*cols: Column) -> Column:
    """A hash in 0 .. 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def sample_bound(share: float) -> int:
    """Hashes up to this one make up ``share`` of all."""
    return min((1 << 63) - 1, int(min(1.0, share) * (1 << 63)))


def hashed_sample(share: float, seed: int, *cols: str) -> Column:
    """Whether a row is in a sample of about ``share``, picked by a hash of ``cols``."""
    return positive_hash(F.lit(seed), *cols) <= sample_bound(share)


#: Rows that are sent to all executors at once, at most; more are joined by a shuffle.
SENT_ROWS = 500_000


def sent_if_few(rows: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """``rows``, which is at rest, marked for a broadcast where its count allows that."""
    return F.broadcast(rows) if rows.count() <= most else rows


def ranked(df: DataFrame, by: list[str], rank: str) -> DataFrame:
    """``df`` with ``rank`` from 0 in the order of ``by``, whose last column tells rows apart.

    Rows are sorted by range, so equal values of the first columns may fill several tasks,
    and the counts of the ranges, one row for each, give each its first rank.
    """
    part, place, first = (free(df, f"__quill_{x}") for x in ("part", "place", "first"))
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # the low 33 bits count the rows of a partition
    rows = cut(rows.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    return rows.join(F.broadcast(firsts), part).withColumn(rank, F.col(first) + F.col(place)).drop(part, place, first)


def row_salt() -> Column:
    """A number of each row that tells it apart; for a frame that is cut next, so that it stays as it is."""
    return F.xxhash64(F.lit(97), F.monotonically_increasing_id())
