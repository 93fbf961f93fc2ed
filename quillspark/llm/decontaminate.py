"""Benchmark decontamination by a broadcast hash set of test n-grams.

Words are runs of ASCII letters (lower-cased), ASCII digits and characters beyond ASCII.
Every 13 consecutive words of a test item are a window; an item of fewer, but not none,
is one window. Token windows of the training texts are hashed and looked up; hits are
verified word by word. A word inside any occurrence of a window is hit.

The test set is read in blocks of a bounded number of words; a long item is cut into
parts that overlap by a window less one word. One block at a time is built, broadcast,
passed over all documents, and dropped, so memory does not grow with the test set, only
the number of passes. With one block its hits are a column of the documents; with more,
the few texts with hits are put at rest after each pass, by the digest of the text, and
meet the documents in a join.

A null text has no words; an item without words has no window. Item ids are carried as
strings. Items that repeat count by their item_id; those without one count as one item
that has no name. Documents keep all their columns, and their repeated rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import all_of, cut, digest_of, free, sent_if_few, text_batches

WINDOW = 13
#: Words of test items in one broadcast block.
BLOCK_WORDS = 300_000
_KEEP = bytes(c if chr(c).isdigit() or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BASE = np.uint64(0x100000001B3)
_RESULT = "n_words long, spans array<long>, items array<string>"
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


class Block:
    """Windows of some test items: hashes by length, and what verifies a hit."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.ids: dict[bytes, int] = {}
        windows: dict[int, dict[tuple[int, ...], set[str | None]]] = {}
        for item, words in items:
            coded = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            if not coded:
                continue
            size = min(window, len(coded))
            for k in range(len(coded) - size + 1):
                windows.setdefault(size, {}).setdefault(tuple(coded[k : k + size]), set()).add(item)
        self.windows = {size: {w: _in_order(x) for w, x in found.items()} for size, found in windows.items()}
        self.hashes = {size: np.unique(rolling(np.array(list(found)), size)[:, 0]) for size, found in self.windows.items()}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        coded = np.fromiter((self.ids.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        outside = np.concatenate([[0], np.cumsum(coded == 0)])
        spans, items = [], set()
        for size, hashes in self.hashes.items():
            if len(coded) < size:
                continue
            may = np.flatnonzero(outside[size:] == outside[:-size])
            if not len(may):
                continue
            keys = rolling(coded[None, :], size)[0][may]
            at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
            for k in may[hashes[at] == keys].tolist():
                if (found := self.windows[size].get(tuple(coded[k : k + size].tolist()))) is not None:
                    spans.append((k, k + size))
                    items.update(found)
        return spans, items


def _in_order(items: set[str | None]) -> list[str | None]:
    """As strings, with the missing one last."""
    return sorted(items, key=lambda x: (x is None, x or ""))


def rolling(coded: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` in each row of ``coded``."""
    x = coded.astype(np.uint64)
    n = x.shape[1] - size + 1
    out = np.zeros((x.shape[0], n), dtype=np.uint64)
    for k in range(size):
        out = out * _BASE + x[:, k : k + n] * np.uint64(0x9E3779B97F4A7C15)
    return out


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Flat starts and ends of the union of ``spans``."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _blocks(benchmark: DataFrame, window: int, most: int):
    """Blocks of about ``most`` words; only one is held here at a time."""
    items, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        step = max(most, window)
        # parts overlap, so that every window is whole in one of them
        for a in range(0, max(1, len(words) - window + 1), step):
            part = words[a : a + step + window - 1]
            items.append((row["item_id"], part))
            n += len(part)
            if n >= most:
                yield Block(items, window)
                items, n = [], 0
    if items:
        yield Block(items, window)


def _scan(sent):
    @F.pandas_udf(_RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            words = words_of(value)
            spans, items = sent.value.scan(words) if sent is not None else ([], set())
            rows.append((len(words), merged(spans), _in_order(items)))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return scan


def _together(spans: pd.Series) -> pd.Series:
    """The union of spans of several blocks."""
    return pd.Series([merged([(int(a), int(b)) for own in x for a, b in zip(own[::2], own[1::2], strict=True)]) for x in spans], dtype=object)


def _n_words(texts: pd.Series) -> pd.Series:
    return pd.Series([len(words_of(t)) for t in texts], dtype="int64")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "__quill_hits", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``out``: the number of words, the hit spans (flat word starts and ends) and the items found."""
    spark = docs.sparkSession
    text_batches(spark)
    blocks = _blocks(benchmark, window, block_words)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        sent = spark.sparkContext.broadcast(first) if first else None
        return docs.withColumn(out, _scan(sent)(F.col(text)))
    key, hits = free(docs, "__quill_key"), free(docs, "__quill_found")
    own = docs.select(digest_of(F.col(text)).alias(key), F.col(text).alias("_text"))
    passes, block = [], first
    while block is not None:
        sent = spark.sparkContext.broadcast(block)
        found = own.select(key, _scan(sent)("_text").alias("h")).where(F.size("h.spans") > 0)
        passes.append(cut(found.select(key, "h.spans", "h.items").dropDuplicates([key])))
        sent.destroy()
        block, second = second, next(blocks, None)
    every = passes[0]
    for other in passes[1:]:
        every = every.unionByName(other)
    every = every.groupBy(key).agg(F.collect_list("spans").alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    every = cut(every.select(key, F.struct(F.pandas_udf(_together, "array<long>")("spans").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items")).alias(hits)))
    joined = docs.withColumn(out, digest_of(F.col(text))).join(sent_if_few(every, 10_000), F.col(out) == F.col(key), "left")
    none = F.struct(F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    whole = F.coalesce(hits, none)
    return joined.withColumn(out, F.struct(F.pandas_udf(_n_words, "long")(F.col(text)).alias("n_words"), whole["spans"].alias("spans"), whole["items"].alias("items"))).select(*all_of(docs), out)


def n_hit(out: str = "__quill_hits"):
    """Words in the spans."""
    return F.aggregate(
        F.transform(f"{out}.spans", lambda x, k: F.when(k % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x
    )


def is_contaminated(out: str = "__quill_hits"):
    """A hit, and hits in one word of twenty at least."""
    return (n_hit(out) > 0) & (20 * n_hit(out) >= F.col(f"{out}.n_words"))


def report(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The counts of each document, without its text."""
    found = contamination(docs.select("doc_id", "text"), benchmark, block_words=block_words)
    named = F.array_join(F.array_sort("__quill_hits.items"), ",")
    return found.select(
        "doc_id", F.col("__quill_hits.n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("__quill_hits.items").cast("long").alias("n_items"),
        F.sha2(named, 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without contaminated documents."""
    out = free(docs, "__quill_hits")
    return contamination(docs, benchmark, out=out, block_words=block_words).where(~is_contaminated(out)).select(*all_of(docs))


def remove_spans(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the hit words, and what stands between them, cut out of the texts."""

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cuts in zip(texts, spans, strict=True):
            if text is not None and len(cuts):
                at = [m.span() for m in _WORD.finditer(text)]
                for a, b in reversed(list(zip(cuts[::2], cuts[1::2], strict=True))):
                    text = text[: at[a][0]] + text[at[b - 1][1] :]
            out.append(text)
        return pd.Series(out)

    out = free(docs, "__quill_hits")
    found = contamination(docs, benchmark, out=out, block_words=block_words).withColumn("text", without("text", f"{out}.spans"))
    return found.select(*all_of(docs))
