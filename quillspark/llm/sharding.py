"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash within each source; a row of rank r among the n of its
source has the fractional rank (r + 1/2) / n. All rows in the order of their fractional
rank are cut into shards of equal counts (at most one apart), so each shard holds every
source in its share of the whole.

Ranks come from sorting by range, with a salt of each row as the last key, so neither a
source, nor a doc_id, nor equal rows that are a third of all are sorted in one task.

A null source is a source of its own; a null text has size 1 and the checksum of no
bytes. Equal texts and repeated rows are placed as rows of their own: the law is
``rows``. Columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import all_of, cut, free, positive_hash, ranked, row_salt, sent_if_few


def interleave(rows: DataFrame, shards: int, strata: str = "source", key: str = "doc_id", seed: int = 11) -> DataFrame:
    """``rows`` with shard and slot, gapless from 0 in each shard. Columns of these names are replaced."""
    rows = rows.drop("shard", "slot")
    own = all_of(rows)
    stratum, order, salt, rank, spread, n, first = (free(rows, f"__quill_{x}") for x in ("stratum", "order", "salt", "rank", "spread", "n", "first"))
    marked = F.when(F.col(strata).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(strata).cast("string")))
    rows = cut(rows.withColumns({stratum: marked, order: positive_hash(F.lit(seed), F.col(key)), salt: row_salt()}))
    rows = ranked(rows, [stratum, order, salt], rank)
    sizes = cut(rows.groupBy(stratum).agg(F.count(F.lit(1)).alias(n), F.min(rank).alias(first)))
    total = sizes.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    # 2**62 leaves room: the fraction is below 1
    share = (F.col(rank) - F.col(first) + 0.5) / F.col(n) * float(1 << 62)
    rows = rows.join(sent_if_few(sizes), stratum).withColumn(spread, share.cast("long")).drop(rank, n, first)
    placed = ranked(rows, [spread, order, salt], rank)
    shard = F.expr(f"(`{rank}` * {shards}) div {max(total, 1)}").cast("int")
    at = F.col(rank) - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", at).select(*own, "shard", "slot")


def report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Sizes, checksums and places of all documents."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    slim = docs.select("doc_id", "source", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = interleave(slim, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
