"""Best-fit packing in bulk-synchronous rounds.

Documents become token pieces of at most ``capacity``. Pieces are placed by classes of
length, each half as long as the one before, the longest first; a piece of over half the
capacity opens a sequence. In a round, the unplaced pieces of a class and the gaps of all
sequences are sorted together by range, from large to small, a gap that holds several
pieces of the class as several places. Each task sweeps over its range: a piece takes the
smallest place that holds it, its successor in the order, and where several pieces have
the same successor, their rank decides, so that the next one takes the next place. What
a range leaves over is handed on: its places serve the pieces of later ranges, by counts
of one row a range. Gaps are then updated, and rounds repeat until no piece of the class
finds a place; the rest open new sequences, cut from their order. State is at rest after
each round.

Nulls and empty texts are documents of the end id alone. A document with n > capacity
ids gives full pieces, after a first one of what remains. Repeated rows are packed as
often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import all_of, arrow_batches, cut, free, shuffle_partitions, text_batches
from quillspark.llm.tokens import encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document; ``with_ids`` adds the ids themselves."""
    text_batches(docs.sparkSession)

    def cut_up(batches):
        enc = encoder(tokenizer, end_id)
        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for ids, lengths in enc.encode(batch.column(1).to_pylist()):
                raw, pos, out = memoryview(ids.astype("<u4").tobytes()), 0, ([], [], [], [], [], [])
                for n in lengths.tolist():
                    start, piece = 0, 0
                    while start < n:
                        size = (n - start) % capacity or capacity
                        a, b = pos + start, pos + start + size
                        row = (doc_ids[at], piece, start, size, zlib.crc32(raw[4 * a : 4 * b]))
                        for column, x in zip(out, row, strict=False):
                            column.append(x)
                        if with_ids:
                            out[5].append(ids[a:b].tolist())
                        start, piece = start + size, piece + 1
                    pos, at = pos + n, at + 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=False)], names)

    return docs.select("doc_id", "text").mapInArrow(cut_up, _PIECES + ", ids array<long>" * with_ids)


def classes(capacity: int) -> list[tuple[int, int]]:
    """(low, high) of each class of lengths, low excluded: halves, and at last all that is short."""
    bounds = [capacity]
    while bounds[-1] > 1 and bounds[-1] > capacity // 32:
        bounds.append(bounds[-1] // 2)
    bounds = [*bounds[: max(1, len(bounds) - 1)], 0]
    return list(zip(bounds[1:], bounds[:-1], strict=True))


def match(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Match pieces to places that stand in one order, from large to small.

    ``piece`` tells pieces from places. Each piece takes the last place before it that is
    still free. Gives the positions of matched places and of their pieces, of pieces left
    without a place, and of free places.
    """
    level = np.cumsum(np.where(piece, -1, 1))
    lowest = np.minimum(np.minimum.accumulate(level), 0) if len(level) else level
    before = np.concatenate([[0], lowest[:-1]])
    alone = piece & (lowest < before)
    depth = level - lowest + piece  # of the place that a piece takes, and of a place
    own = np.flatnonzero(~alone)
    own = own[np.lexsort((own, depth[own]))]
    taken = np.zeros(len(own), dtype=bool)
    taken[:-1] = ~piece[own[:-1]] & piece[own[1:]] & (depth[own[:-1]] == depth[own[1:]])
    at = np.flatnonzero(taken)
    free_places = np.ones(len(piece), dtype=bool)
    free_places[own[at]] = False
    return own[at], own[at + 1], np.flatnonzero(alone), np.flatnonzero(free_places & ~piece)


_MATCHED, _PLACE, _PIECE = range(3)
_SWEPT = "kind int, id long, seq long, length long, part int, k long"


def _sweep(batches):
    """(size, piece, id) from large to small -> matches, places and pieces left over, these numbered in their order."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    places = np.zeros((0, 2), dtype=np.int64)  # the free ones so far: size, sequence
    n_pieces = 0

    def rows(kind: int, id, seq, length, first: int) -> pa.RecordBatch:
        n = len(length)
        cols = [np.full(n, kind, np.int32), id, seq, length, np.full(n, part, np.int32), np.arange(first, first + n, dtype=np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "id", "seq", "length", "part", "k"])

    for batch in batches:
        size, is_piece, id = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        size, id = np.concatenate([places[:, 0], size]), np.concatenate([places[:, 1], id])
        is_piece = np.concatenate([np.zeros(len(places), dtype=bool), is_piece.astype(bool)])
        place, piece, alone, unused = match(is_piece)
        yield rows(_MATCHED, id[piece], id[place], size[piece], 0)
        yield rows(_PIECE, id[alone], id[alone], size[alone], n_pieces)
        n_pieces += len(alone)
        places = np.stack([size[unused], id[unused]], axis=1)
    yield rows(_PLACE, places[:, 1], places[:, 1], places[:, 0], 0)


def _handed_on(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """From (range, pieces, places) left over: (range and first of some pieces, how many, range and last of the places they take)."""
    stack: list[list[int]] = []
    out = []
    for part, pieces, places in sorted(left):
        done = 0
        while done < pieces and stack:
            top = stack[-1]
            n = min(pieces - done, top[1])
            out.append((part, done, n, top[0], top[1] - 1))
            done += n
            top[1] -= n
            if not top[1]:
                stack.pop()
        if places:
            stack.append([part, places])
    return out


def _round(todo: DataFrame, gaps: DataFrame, low: int, high: int):
    """One round for the pieces ``todo`` (id, length) of a class: (matches (id, seq, length), what is left of todo, gaps, whether any matched)."""
    spark = todo.sparkSession
    live = gaps.where(F.col("gap") > low)
    n = F.greatest(F.lit(1), F.expr(f"cast(gap div {high} as int)"))
    places = live.select("seq", F.explode(F.sequence(F.lit(1), n)).alias("j"), n.alias("n"), "gap")
    size = F.when(F.col("j") < F.col("n"), F.lit(high)).otherwise(F.col("gap") - (F.col("n") - 1) * high).cast("long")
    places = places.select(size.alias("size"), F.lit(0).alias("piece"), F.col("seq").alias("id"), F.xxhash64("seq", "j").alias("h"))
    pieces = todo.select(F.col("length").alias("size"), F.lit(1).alias("piece"), "id", F.xxhash64("id").alias("h"))
    order = [F.desc("size"), F.asc("piece"), F.asc("h")]
    rows = places.unionByName(pieces).repartitionByRange(*order).sortWithinPartitions(*order).select("size", "piece", "id")
    with arrow_batches(spark, 50_000):
        swept = cut(rows.mapInArrow(_sweep, _SWEPT))
    counts = swept.groupBy("part").agg(*[F.count_if(F.col("kind") == k).alias(f"n{k}") for k in (_MATCHED, _PLACE, _PIECE)]).collect()
    handed = _handed_on([(r["part"], r[f"n{_PIECE}"], r[f"n{_PLACE}"]) for r in counts])
    found = swept.where(F.col("kind") == _MATCHED).select("id", "seq", "length")
    left = swept.where(F.col("kind") == _PIECE)
    if handed:
        plan = F.broadcast(spark.createDataFrame(handed, "part int, first long, n long, from int, last long"))
        inside = (left["part"] == plan["part"]) & left["k"].between(plan["first"], plan["first"] + plan["n"] - 1)
        served = left.join(plan, inside).select("id", "length", F.col("from").alias("part"), (F.col("last") - (F.col("k") - F.col("first"))).alias("k"))
        free_places = swept.where(F.col("kind") == _PLACE).select("part", "k", "seq")
        found = cut(found.unionByName(served.join(free_places, ["part", "k"]).select("id", "seq", "length")))
        left = left.join(plan, inside, "left_anti")
    n_matched = sum(r[f"n{_MATCHED}"] for r in counts) + sum(h[2] for h in handed)
    if n_matched:
        used = found.groupBy("seq").agg(F.sum("length").alias("used"))
        gaps = cut(gaps.join(used, "seq", "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).where("gap > 0"))
    n_left = sum(r[f"n{_PIECE}"] for r in counts) - sum(h[2] for h in handed)
    return found, left.select("id", "length"), gaps, n_matched, n_left


#: Sequences that a task opens, about, so that few stay half empty at the end of a range.
_OPENED = 1000


def _open(todo: DataFrame, capacity: int) -> DataFrame:
    """New sequences for ``todo``, from the longest: rows (id, seq, length), and (null, seq, gap) for what they leave."""

    def opened(batches):
        seq, room = -1, 0
        for batch in batches:
            id, length = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            total = np.cumsum(length)
            out, gaps, at = np.empty(len(id), dtype=np.int64), [], 0
            while at < len(id):
                if length[at] > room:
                    if seq >= 0:
                        gaps.append((seq, room))
                    seq, room = int(id[at]), capacity
                start = int(total[at] - length[at])
                end = int(np.searchsorted(total, start + room, side="right"))
                out[at:end] = seq
                room -= int(total[end - 1]) - start
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(id), pa.array(out), pa.array(length)], ["id", "seq", "length"])
            if gaps:
                yield _gap_rows(gaps)
        if seq >= 0:
            yield _gap_rows([(seq, room)])

    def _gap_rows(gaps):
        return pa.RecordBatch.from_arrays([pa.nulls(len(gaps), pa.int64()), pa.array([g[0] for g in gaps], pa.int64()), pa.array([g[1] for g in gaps], pa.int64())], ["id", "seq", "length"])

    spark = todo.sparkSession
    total = todo.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(1, min(shuffle_partitions(spark), total // (capacity * _OPENED)))
    order = [F.desc("length"), F.asc(F.xxhash64("id"))]
    rows = todo.select("id", "length").repartitionByRange(n, *order).sortWithinPartitions(*order)
    with arrow_batches(spark, 50_000):
        return cut(rows.mapInArrow(opened, "id long, seq long, length long"))


def best_fit(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """(id, seq, length) of ``pieces`` (id, length), at rest; a sequence is named by the piece that opens it."""
    if pieces.where((F.col("length") > capacity) | (F.col("length") < 1)).take(1):
        raise ValueError(f"pieces must have 1 to {capacity} ids")
    bounds = classes(capacity)
    by = F.lit(0)
    for k, (low, high) in enumerate(bounds):
        by = F.when((F.col("length") > low) & (F.col("length") <= high), F.lit(k)).otherwise(by)
    counts = {r["c"]: r["n"] for r in pieces.groupBy(by.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    half = bounds[0][0]
    long = pieces.where(F.col("length") > half)
    placed = [long.select("id", F.col("id").alias("seq"), "length")]
    gaps = long.where(F.col("length") < capacity).select(F.col("id").alias("seq"), (F.lit(capacity) - F.col("length")).cast("long").alias("gap"))
    for k, (low, high) in list(enumerate(bounds))[1:]:
        todo, left = pieces.where((F.col("length") > low) & (F.col("length") <= high)).select("id", "length"), counts.get(k, 0)
        while left:
            found, todo, gaps, matched, left = _round(todo, gaps, low, high)
            if not matched:
                break
            placed.append(found)
            if left and gaps.agg(F.coalesce(F.max("gap"), F.lit(0))).first()[0] < todo.agg(F.min("length")).first()[0]:
                break
        if left:
            new = _open(todo, capacity)
            placed.append(new.where("id IS NOT NULL"))
            gaps = gaps.unionByName(new.where("id IS NULL AND length > 0").select("seq", F.col("length").alias("gap")))
    return reduce(DataFrame.unionByName, placed)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (length, and other columns) with sequence_id and offset."""
    pieces = pieces.drop("sequence_id", "offset")
    id, own = free(pieces, "__quill_id"), all_of(pieces)
    pieces = cut(pieces.withColumn(id, F.monotonically_increasing_id()))
    slim = pieces.select(F.col(id).alias("id"), F.col("length").cast("long").alias("length"))
    placed = best_fit(slim, capacity)
    # at most ``capacity`` rows a sequence
    before = Window.partitionBy("seq").orderBy(F.desc("length"), "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(F.col("id").alias(id), F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return pieces.join(placed, id).select(*own, "sequence_id", "offset")
