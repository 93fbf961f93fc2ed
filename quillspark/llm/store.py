"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document into chunks, so equal passages give
equal chunks; each is stored once, under its SHA-256. A document's recipe lists its
chunks, with a Merkle root over them; the manifest has a root over the recipes of each
file, and the root of the store is one over the manifest. Reading checks all of them, so
a damaged or missing chunk, recipe, file or manifest row raises.

Format: ``chunks/`` (digest, ids as little-endian unsigned integers of ``width``
bytes), ``recipes/`` in ascending doc_id order (doc_id, part, n_tokens, digests, root),
``manifest/`` (part, documents, tokens, root), ``root/`` (parts, documents, tokens, root).
Nulls and empty texts hold the end id alone; rows that repeat have a recipe each; an
empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, files_at, remove, shared_path, text_batches
from quillspark.llm.filters import may_repeat
from quillspark.llm.tokens import encoder

MIN_IDS, MAX_IDS, MEAN_BITS, WINDOW = 64, 1024, 8, 8
#: Children of a node in the trees over a part's documents and over parts.
FAN_OUT = 1000
#: Digests that a task remembers, so as not to hand on the same chunk again and again.
_RECENT = 200_000


def chunk_ends(ids: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
    """For each document, the ends of its chunks, counted from the start of ``ids``."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    rolled = x.copy()
    for k in range(1, WINDOW):
        rolled[k:] += x[:-k] << np.uint64(k)
    hits = np.flatnonzero((rolled >> np.uint64(40)) & np.uint64((1 << MEAN_BITS) - 1) == 0) + 1
    out, stops = [], np.cumsum(lengths)
    for a, b in zip((stops - lengths).tolist(), stops.tolist(), strict=True):
        ends, last = [], a
        i, j = np.searchsorted(hits, [a + MIN_IDS, b])
        for h in hits[i:j].tolist():
            while h - last > MAX_IDS:
                last += MAX_IDS
                ends.append(last)
            if h - last >= MIN_IDS:
                ends.append(h)
                last = h
        while b - last > MAX_IDS:
            last += MAX_IDS
            ends.append(last)
        out.append([*ends, b])
    return out


def merkle(digests: list[bytes]) -> bytes:
    level = list(digests) or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[k : k + 2])).digest() for k in range(0, len(level), 2)]
    return level[0]


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, width: int = 2) -> None:
    """Encode ``docs`` (doc_id, text) and write the store."""
    spark = docs.sparkSession
    text_batches(spark)
    kind = {2: "<u2", 4: "<u4"}[width]

    def chunked(batches):
        enc, seen = encoder(tokenizer, end_id), set()
        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for ids, lengths in enc.encode(batch.column(1).to_pylist()):
                if len(ids) and int(ids.max()) >= 1 << 8 * width:
                    raise ValueError(f"an id does not fit in {width} bytes")
                raw = memoryview(ids.astype(kind).tobytes())
                all_digests, all_fresh, all_chunks, first = [], [], [], 0
                for ends in chunk_ends(ids, lengths):
                    digests, fresh, chunks = [], [], []
                    for end in ends:
                        chunk = raw[width * first : width * end]
                        digest = hashlib.sha256(chunk).digest()
                        digests.append(digest)
                        if digest not in seen:
                            seen.add(digest)
                            fresh.append(digest)
                            chunks.append(bytes(chunk))
                        first = end
                    all_digests.append(digests)
                    all_fresh.append(fresh)
                    all_chunks.append(chunks)
                if len(seen) > _RECENT:
                    seen.clear()
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[at : at + n], pa.int64()), pa.array(lengths, pa.int64()), pa.array(all_digests, pa.list_(pa.binary())), pa.array(all_fresh, pa.list_(pa.binary())), pa.array(all_chunks, pa.list_(pa.binary())), pa.array([merkle(x) for x in all_digests], pa.binary())],
                    ["doc_id", "n_tokens", "digests", "fresh", "chunks", "root"],
                )
                at += n

    staged = f"{path}/staged"
    rows = docs.select("doc_id", "text").mapInArrow(chunked, "doc_id long, n_tokens long, digests array<binary>, fresh array<binary>, chunks array<binary>, root binary")
    rows.write.option("compression", "zstd").parquet(staged)
    rows = spark.read.parquet(staged)
    # only chunks that several tasks may have handed on are shuffled
    index = cut(rows.select(F.explode("fresh").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")))
    repeats = may_repeat(index)
    chunks = rows.select(F.explode(F.arrays_zip("fresh", "chunks")).alias("x")).select(F.col("x.fresh").alias("digest"), F.col("x.chunks").alias("ids"))
    split = f"{path}/split"
    chunks.withColumn("several", repeats(F.col("digest"))).write.option("compression", "zstd").partitionBy("several").parquet(split)
    several = spark.read.schema("digest binary, ids binary, several boolean").parquet(split).where("several").drop("several")
    several.groupBy("digest").agg(F.first("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    _take(spark, f"{split}/several=false", f"{path}/chunks")
    remove(spark, split)
    recipes = rows.select("doc_id", "n_tokens", "digests", "root").repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    recipes.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/recipes")
    written = spark.read.parquet(f"{path}/recipes")
    _roots(written).write.parquet(f"{path}/manifest")
    _store_root(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/root")
    remove(spark, staged)


def _take(spark: SparkSession, source: str, target: str) -> None:
    """Move the files of one folder into another."""
    where, files = files_at(spark, source)
    if files.exists(where):
        for f in files.listStatus(where):
            name = f.getPath().getName()
            if name.startswith("part-") and not files.rename(f.getPath(), files_at(spark, f"{target}/{name}")[0]):
                raise OSError(f"cannot move {f.getPath()} to {target}")


def _tree(leaves: DataFrame, keys: list[str], deep: int) -> DataFrame:
    """Roots of ``leaves`` (keys, k from 0, h, documents, tokens) by ``keys``, over ``deep`` levels. No group is larger than the fan-out."""
    level = leaves
    for _ in range(deep):
        own = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
        level = level.groupBy(*keys, F.expr(f"k div {FAN_OUT}").alias("k")).agg(F.sha2(own, 256).alias("h"), F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"))
    return level


def _deep(n: int) -> int:
    """Levels of a tree over ``n`` leaves."""
    return max(1, math.ceil(math.log(max(n, 2), FAN_OUT) - 1e-9))


def _roots(recipes: DataFrame) -> DataFrame:
    """The Merkle root of each part's documents, in their order."""
    most = recipes.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    order = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "root")) - 1
    leaf = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex("root")), 256)
    one = F.lit(1).cast("long")
    leaves = recipes.select("part", order.cast("long").alias("k"), leaf.alias("h"), one.alias("leaves"), F.col("n_tokens").alias("tokens"), one.alias("documents"))
    return _tree(leaves, ["part"], _deep(most)).select("part", "documents", "tokens", F.col("h").alias("root"))


def _store_root(manifest: DataFrame) -> DataFrame:
    """One row: the root over the parts' roots."""
    leaf = F.sha2(F.concat_ws(":", F.col("part").cast("string"), "documents", "tokens", "root"), 256)
    leaves = manifest.select(F.col("part").cast("long").alias("k"), leaf.alias("h"), F.lit(1).cast("long").alias("leaves"), "tokens", "documents")
    last = manifest.agg(F.max("part")).first()[0] or 0
    return _tree(leaves, [], _deep(last + 1)).select(F.col("leaves").alias("parts"), "documents", "tokens", F.col("h").alias("root"))


def _product(a: int, b: int) -> int:
    """a * b in the field of CRC-32, lowest powers in the highest bits."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        bit >>= 1
    return out


def _shifts(most: int) -> np.ndarray:
    """What moves a CRC-32 on by n ids of 4 bytes, for each n up to ``most``: a table for each of its bytes."""
    word = 1 << 30
    for _ in range(5):
        word = _product(word, word)
    one = np.array([[_product(word, v << 8 * byte) for v in range(256)] for byte in range(4)], dtype=np.uint32)
    out = np.empty((most + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, most + 1):
        out[n] = _moved(one[None], np.zeros(out[0].shape, dtype=np.int64), out[n - 1])
    return out


def _moved(tables: np.ndarray, n: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[n, 0, crc & 255]
    for byte in range(1, 4):
        out = out ^ tables[n, byte, crc >> (8 * byte) & 255]
    return out


def read_chunks(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(digest, crc, n) of each chunk, from its bytes, which must match the digest."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def verified(batches):
        for batch in batches:
            digests, crcs, sizes = batch.column(0).to_pylist(), [], []
            for digest, raw in zip(digests, batch.column(1).to_pylist(), strict=True):
                if hashlib.sha256(raw).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                ids = np.frombuffer(raw, dtype=kind)
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int32())], ["digest", "crc", "n"])

    text_batches(spark)
    return spark.read.parquet(f"{path}/chunks").select("digest", "ids").mapInArrow(verified, "digest binary, crc long, n int")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with ``start``, the number of ids of all documents before."""
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = spark.read.parquet(f"{path}/manifest").select("part", F.coalesce(F.sum("tokens").over(parts), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return recipes.join(before, "part").withColumn("start", start).drop("_before")


def verify_store(spark: SparkSession, path: str) -> None:
    """Raise unless the recipes match the manifest, and the manifest the root of the store."""
    manifest = spark.read.parquet(f"{path}/manifest")
    key = ["part", "documents", "tokens", "root"]
    found, listed = cut(_roots(spark.read.parquet(f"{path}/recipes"))), manifest.select(*key)
    if found.join(listed, key, "left_anti").take(1) or listed.join(found, key, "left_anti").take(1):
        raise ValueError("the recipes do not match their manifest")
    if [tuple(r) for r in _store_root(manifest).collect()] != [tuple(r) for r in spark.read.parquet(f"{path}/root").collect()]:
        raise ValueError("the manifest does not match the root of the store")


def summaries(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the store's files.

    A document's CRC-32 is put together from those of its chunks, so chunks that many
    documents share are read once and their bytes are not shuffled.
    """
    verify_store(spark, path)
    recipes = read_recipes(spark, path)
    refs = recipes.select("start", F.posexplode("digests").alias("pos", "digest"))
    own = F.sort_array(F.collect_list(F.struct("pos", "crc", "n", "digest")))
    # a chunk or list that is missing stays as a null, which raises below
    parts = refs.join(read_chunks(spark, path, width), "digest", "left").groupBy("start").agg(own.alias("parts"))
    lists = [F.col(f"parts.{c}").alias(c) for c in ("crc", "n", "digest")]

    def joined(batches):
        shifts = _shifts(MAX_IDS)
        for batch in batches:
            crcs, sizes, digests = batch.column("crc"), batch.column("n"), batch.column("digest").to_pylist()
            if crcs.null_count or crcs.values.null_count:
                raise ValueError("a document's chunks are missing")
            at, ends = (crcs.offsets.to_numpy()[k : len(crcs) + k].astype(np.int64) for k in (0, 1))
            crc_of, n_of = crcs.values.to_numpy().astype(np.uint32), sizes.values.to_numpy().astype(np.int64)
            crc, total = np.zeros(len(crcs), dtype=np.uint32), np.zeros(len(crcs), dtype=np.int64)
            while (left := np.flatnonzero(at < ends)).size:  # the next chunk of each document that has one
                n = n_of[at[left]]
                crc[left] = _moved(shifts, n, crc[left]) ^ crc_of[at[left]]
                total[left] += n
                at[left] += 1
            if [merkle(x) for x in digests] != batch.column("root").to_pylist():
                raise ValueError("a document's chunks do not match its root")
            if not (total == batch.column("n_tokens").to_numpy()).all():
                raise ValueError("a document's length does not match its recipe")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    whole = recipes.join(parts, "start", "left").select("doc_id", "start", "n_tokens", "root", *lists)
    return whole.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def reconstruct(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, ids): every document's ids, put together from its chunks, which must match their digests."""
    verify_store(spark, path)
    text_batches(spark)
    kind = {2: "<u2", 4: "<u4"}[width]
    recipes = read_recipes(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks")
    parts = recipes.select("start", F.posexplode("digests").alias("pos", "digest")).join(chunks, "digest", "left")
    parts = parts.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "ids"))).alias("parts"))
    whole = recipes.join(parts, "start", "left").select("doc_id", "start", "root", "parts")

    def joined(batches):
        for batch in batches:
            out = []
            for root, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if own is None or any(x["ids"] is None for x in own):
                    raise ValueError("a document's chunks are missing")
                if any(hashlib.sha256(x["ids"]).digest() != x["digest"] for x in own) or merkle([x["digest"] for x in own]) != root:
                    raise ValueError("a document's chunks are damaged")
                out.append(np.frombuffer(b"".join(x["ids"] for x in own), dtype=kind).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return whole.mapInArrow(joined, "doc_id long, start long, ids array<long>")


def new_store(docs: DataFrame, tokenizer: str, end_id: int = 1) -> str:
    """Write a store into the shared folder and return its path."""
    path = shared_path(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer, end_id)
    return path
