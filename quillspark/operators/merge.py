"""Upsert by key.

Keys match null-safely. Target rows with a match take the source's values, source rows
without one are added, and all others stay. The target's partitions are pruned to those
that the source has. It is one full outer join on a struct of the keys, in which nulls
are equal; the source is grouped by the same struct, so it is shuffled once, and a key
that it has twice makes the job fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.errors import SchemaMismatch
from quillspark.ids import quote
from quillspark.partition import Day, IntRange, Month, Scheme

#: Distinct partitions of a source that are listed to prune the target.
MOST_PARTITIONS = 10_000


def merge_keys(keys: list[str], scheme: Scheme) -> list[str]:
    """The keys, and the target's partition column where it is a day or a range."""
    extra = [scheme.column] if isinstance(scheme, (Day, IntRange)) else []
    return list(dict.fromkeys([*keys, *extra]))


def source_partitions(source: DataFrame, scheme: Scheme, most: int = MOST_PARTITIONS) -> list | None:
    """Distinct values of the partition column, a null among them; None where they are too many to list."""
    if not isinstance(scheme, (Day, Month, IntRange)):
        return None
    rows = source.select(scheme.column).distinct().limit(most + 1).collect()
    return None if len(rows) > most else [r[0] for r in rows]


def in_partitions(column: str, values: list) -> Column:
    given = [v for v in values if v is not None]
    own = F.col(column).isin(given) if given else F.lit(False)
    return own | F.col(column).isNull() if len(given) < len(values) else own


def _same(a: DataFrame, b: DataFrame) -> None:
    of = lambda df: [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    if of(a) != of(b):
        raise SchemaMismatch([f"source has {x}, target has {y}" for x, y in zip(of(a) + [None] * len(of(b)), of(b) + [None] * len(of(a)), strict=False) if x != y])


#: Begins the message of a failure for a key that occurs twice.
TWICE = "quillspark:twice:"


def upsert(source: DataFrame, target: DataFrame, keys: list[str], scheme: Scheme | None = None, check: bool = True, prune: bool = False) -> DataFrame:
    """The target after the merge; with ``prune``, only those of its partitions that the source has.

    With ``check``, the result fails where the source has a key twice; without, any one of its rows is taken.
    """
    _same(source, target)
    if scheme is not None:
        keys = merge_keys(keys, scheme)
    if prune and scheme is not None and (values := source_partitions(source, scheme)) is not None:
        target = target.where(in_partitions(scheme.column, values))
    cols = target.columns
    key = F.struct(*[F.col(quote(k)) for k in keys])
    row = F.struct(*[F.col(quote(c)) for c in cols])
    new = source.groupBy(key.alias("__quill_key")).agg(F.first(row).alias("__quill_new"), F.count(F.lit(1)).alias("__quill_n"))
    if check:
        shown = F.concat(F.lit(f"{TWICE}the source has several rows for "), F.to_json("__quill_key"))
        new = new.withColumn("__quill_new", F.when(F.col("__quill_n") == 1, F.col("__quill_new")).otherwise(F.raise_error(shown)))
    old = target.select(key.alias("__quill_own"), row.alias("__quill_old"))
    joined = old.join(new, F.col("__quill_own") == F.col("__quill_key"), "full_outer")
    merged = F.when(F.col("__quill_key").isNotNull(), F.col("__quill_new")).otherwise(F.col("__quill_old"))
    return joined.select(*[merged.getField(c).alias(c) for c in cols])
