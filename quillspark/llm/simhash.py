"""SimHash near-duplicates by covering locality-sensitive hashing.

Each text has a 64-bit fingerprint. For a radius r, every bit gets a vector of r + 1
random bits; each of the 2**(r+1) - 1 non-zero vectors v gives a mask of the bits whose
vector is not orthogonal to v. Some v is orthogonal to the vectors of any r bits, so two
fingerprints that differ in at most r bits agree under its mask: no pair is missed.

Tables hold distinct fingerprints. A bucket of bounded size is linked in one task, by a
spanning forest of its pairs within the radius; a larger one is cut by a further family
of masks over its remaining bits, which is exact for the same reason, until so few bits
remain that their values bound its size. Components are found by alternating large and
small stars, on links between fingerprints.

A null or empty text has fingerprint zero and is linked like any other. Repeated rows
share a component. ``keep_one`` judges each row by its own text: a text that shares its
doc_id with another is not dropped with it, and of rows with the least doc_id of a
component one stays. A missing doc_id is the component's only where it has no other. An
empty table gives an empty result.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import all_of, arrow_batches, cut, digest_of, free, sent_if_few, text_batches

WORDS = 4
RADIUS = 4
#: Fingerprints of one bucket that one task links.
BUCKET = 8192
#: A bucket whose members may differ in this many bits alone has at most 2**16 of them.
FEW_BITS = 16
_BITS = 64


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The majority bits of the hashes of all shingles, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1])
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]
    counts = np.zeros(_BITS, dtype=np.int64)
    for k in range(0, len(found), 20_000):
        raw = np.array(found[k : k + 20_000], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(found), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, fp): fp is the fingerprint as a signed long, text_key tells texts apart."""
    text_batches(docs.sparkSession)

    def marked(batches):
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found)], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), "text")
    return rows.mapInArrow(marked, "doc_id long, text_key binary, fp long")


def _text_key():
    """16 bytes of the SHA-256 of the text."""
    return F.substring(F.unhex(digest_of(F.col("text"))), 1, 16)


def covering_masks(bits: list[int], radius: int, seed: int) -> list[int]:
    """Masks over ``bits``, none empty, of which one leaves out any given ``radius`` bits. Signed, as Spark's longs are."""
    dim = radius + 1
    rng = random.Random(seed)
    # balanced: each non-zero vector stands for as many bits as any other
    vectors = [1 + k % ((1 << dim) - 1) for k in range(len(bits))]
    rng.shuffle(vectors)
    of = dict(zip(bits, vectors, strict=True))
    masks = [sum(1 << b for b in bits if (of[b] & v).bit_count() % 2) for v in range(1, 1 << dim)]
    if not all(masks):
        # too few bits for every vector: of radius + 1 groups of bits, one is left untouched
        masks = [sum(1 << b for b in bits[k::dim]) for k in range(dim)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _near(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``x`` within the radius."""
    links, left = [], np.arange(len(x))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            near = np.bitwise_count(x[left] ^ x[todo[-1]]) <= radius
            at = todo.pop()
            links += [(int(at), int(k)) for k in left[near]]
            todo += left[near].tolist()
            left = left[~near]
    return links


def _link_buckets(radius: int):
    """Rows (bucket columns..., fp), sorted by bucket: links (a, b) within each bucket."""

    def linked(batches):
        def out(keys: np.ndarray, x: np.ndarray):
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(x)]])
            a, b = [], []
            size = ends - starts
            two = starts[size == 2]
            two = two[np.bitwise_count(x[two] ^ x[two + 1]) <= radius]
            a += [x[two]]
            b += [x[two + 1]]
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                found = np.array(_near(x[s:e], radius), dtype=np.int64).reshape(-1, 2)
                a.append(x[s:e][found[:, 0]])
                b.append(x[s:e][found[:, 1]])
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held = None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if held is not None:
                rows = np.concatenate([held, rows])
            if not len(rows):
                continue
            last = len(rows) - int((rows[:, :-1] == rows[-1, :-1]).all(axis=1)[::-1].argmin()) if not (rows[:, :-1] == rows[-1, :-1]).all() else 0
            if last:
                yield out(rows[:last, :-1], np.ascontiguousarray(rows[:last, -1]).view(np.uint64))
            held = rows[last:]
        if held is not None and len(held):
            yield out(held[:, :-1], np.ascontiguousarray(held[:, -1]).view(np.uint64))

    return linked


def _within(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links within buckets that one task can hold."""
    return rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_link_buckets(radius), "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, seed: int = 5) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``fps`` (column fp, distinct) within the radius."""
    with arrow_batches(fps.sparkSession, 50_000):
        return cut(_links(fps, radius, bucket, seed))


def _links(fps: DataFrame, radius: int, bucket: int, seed: int) -> DataFrame:
    spark = fps.sparkSession
    masks = covering_masks(list(range(_BITS)), radius, seed)
    rows = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("m0", "_m")).select(F.col("m0"), F.expr("fp & _m").alias("k0"), "fp")
    keys, out, level = ["m0", "k0"], None, 0
    masks_of = {(): masks}
    while True:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bucket)
        large = cut(sizes.select(*keys))
        n_large = large.count()
        small = rows.join(large, keys, "left_anti") if n_large else rows
        found = _within(small, keys, radius)
        out = found if out is None else out.unionByName(found)
        if not n_large:
            return out.distinct()
        # the members of a large bucket agree on its mask; what is left has fewer bits
        held = rows.join(large, keys, "left_semi")
        names = [k for k in keys if k[0] == "m"]
        nexts, ends = [], []
        for r in large.select(*names).distinct().collect():  # combinations of masks, bounded by the depth
            path = tuple(r)
            fixed = 0
            for depth, k in enumerate(path):
                fixed |= masks_of[path[:depth]][k]
            bits = [b for b in range(_BITS) if not fixed >> b & 1]
            if len(bits) <= FEW_BITS:
                ends.append(path)
            else:
                masks_of[path] = covering_masks(bits, radius, seed + level + 1)
                nexts.append((*path, masks_of[path]))
        level += 1
        if ends:
            done = held.join(F.broadcast(spark.createDataFrame(ends, ", ".join(f"{n} int" for n in names))), names)
            out = out.unionByName(_within(done, keys, radius))
        if not nexts:
            return out.distinct()
        table = spark.createDataFrame(nexts, ", ".join(f"{n} int" for n in names) + ", _ms array<long>")
        rows = cut(held.join(F.broadcast(table), names).select(*keys, "fp", F.posexplode("_ms").alias(f"m{level}", "_m")).withColumn(f"k{level}", F.expr("fp & _m")).select(*keys, f"m{level}", f"k{level}", "fp"))
        keys = [*keys, f"m{level}", f"k{level}"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b): root is the smallest node that it reaches."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("s"))
    last = edges.select(mark.alias("x")).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        edges = cut(small)
        now = edges.select(mark.alias("x")).first()
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, fp, component_id): the smallest doc_id that each document reaches."""
    marked = cut(fingerprints(docs, words))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = cut(fps.join(roots, "fp").unionByName(fps.join(roots.select("root").distinct(), F.col("fp") == F.col("root"))))
    # both sides are at rest, so that Spark can split the join at a large component
    least = cut(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    found = linked.join(least, "root").select("fp", "root", "component_id")
    labels = cut(fps.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id")))
    return marked.join(labels, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints as 16 hex digits, and components."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id."""
    found = cut(near_duplicates(docs, words, radius))
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # rows of the least doc_id of a component, where there are several: one text of them stays
    tied = cut(found.where(first).groupBy("root").agg(F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1"))
    gone = found.where(~first).select("doc_id", "text_key")
    several = bool(tied.take(1))
    if several:
        lost = found.where(first).join(tied.select("root", F.col("text_key").alias("kept")), "root").where(F.col("text_key") != F.col("kept"))
        gone = gone.unionByName(lost.select("doc_id", "text_key"))
    key, id = free(docs, "__quill_key"), free(docs, "__quill_id")
    gone = cut(gone.distinct().select(F.col("text_key").alias(key), F.col("doc_id").alias(id)))
    on = lambda own: (F.col(key) == _text_key()) & F.col("doc_id").cast("long").eqNullSafe(F.col(own))
    left = docs.join(sent_if_few(gone), on(id), "left_anti")
    if not several:
        return left.select(*all_of(docs))
    same = sent_if_few(cut(tied.select(F.col("text_key").alias(key), F.col("doc_id").alias(id))))
    rows = F.first(F.struct(*all_of(docs))).alias("row")
    one = left.join(same, on(id), "left_semi").groupBy("doc_id", "text").agg(rows).select("row.*")
    return left.join(same, on(id), "left_anti").select(*all_of(docs)).unionByName(one)
