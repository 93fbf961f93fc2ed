"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to ``ORDER``. In a context seen n
times with d distinct symbols, a symbol seen c times has probability c / (n + d); any
other escapes with d / (n + d) to the next shorter context, and at last to all byte
values alike. The statistics are frozen after training, so the code length of a text
under a language is an exact sum over its symbols, and the shortest wins. Bytes are
symbols, but for ASCII letters in one case, digits as one, and other ASCII marks as one.

Spark counts the symbols after each context, by language; every context and symbol seen
is kept. Only seen pairs are stored, with their code length in each language; what no
language has seen goes down the orders when a text is scored.

Training takes about ``ROWS`` documents of each language, all of them where there are
fewer, picked by a hash of the doc_id and the text; every text is scored, whole. The
score is the language's share of the likelihood, with code lengths as of a text of
``TEMPER`` symbols where it is longer, so that long texts do not all score 1. A null
text, or one without a letter, is ``und`` with score 0. Repeated rows get equal results.
Without training rows every text is ``und``. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import positive_hash, sample_bound, text_batches

ORDER = 3
#: Training documents of a language, about.
ROWS = 500
#: Symbols that a longer text counts as in its score.
TEMPER = 8
#: Symbols times languages that are scored at once.
_PART = 1 << 22
_LETTER = regex.compile(r"\p{L}")


def _symbols() -> np.ndarray:
    """Of each byte: blanks 0, marks 1, digits 2, letters 3 on, bytes beyond ASCII after them."""
    of = np.ones(256, dtype=np.int64)
    of[[9, 10, 11, 12, 13, 32]] = 0
    of[48:58] = 2
    of[97:123] = of[65:91] = np.arange(3, 29)
    of[128:] = np.arange(29, 157)
    return of


_SYMBOL = _symbols()
#: Bytes that a symbol stands for, and the number of symbols.
_SPREAD = np.bincount(_SYMBOL)
_V = len(_SPREAD)


def codes_of(texts: list[str | None]) -> np.ndarray:
    """For each symbol of some texts, itself and the ``ORDER`` symbols before it as one number; blanks stand before a text."""
    out = [np.zeros(0, dtype=np.int64)]
    for text in texts:
        s = _SYMBOL[np.frombuffer(b" " * ORDER + _bytes(text), dtype=np.uint8)]
        code = np.zeros(len(s) - ORDER, dtype=np.int64)
        for j in range(ORDER + 1):
            code = code * _V + s[j : len(s) - ORDER + j]
        out.append(code)
    return np.concatenate(out)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


@dataclass
class Level:
    """Contexts of one order."""

    node: np.ndarray  # context -> its number, or -1
    slot: np.ndarray  # number of a context and symbol -> row of ``bits``, or -1
    bits: np.ndarray  # code length of a seen symbol by language
    escape: np.ndarray  # bits of an escape from a context by language


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]  # of orders 0 to ORDER

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text by language."""
        out = np.zeros((len(texts), len(self.languages)))
        size, most = 0, max(1, _PART // max(1, len(self.languages)))
        part: list[tuple[int, bytes]] = []
        for k, text in enumerate(texts):
            # blanks before a text are its first contexts; a long one goes in pieces, each after the end of the last
            whole = b" " * ORDER + text
            for a in range(0, len(text), most):
                part.append((k, whole[a : a + most + ORDER]))
                size += len(part[-1][1])
                if size >= most:
                    self._add(out, part)
                    part, size = [], 0
        if part:
            self._add(out, part)
        return out

    def _add(self, out: np.ndarray, part: list[tuple[int, bytes]]) -> None:
        s = _SYMBOL[np.frombuffer(b"".join(raw for _, raw in part), dtype=np.uint8)]
        context = np.zeros(len(s) - ORDER, dtype=np.int64)
        for j in range(ORDER):
            context = context * _V + s[j : len(s) - ORDER + j]
        cost = self.cost(context, s[ORDER:])
        ends = np.cumsum([len(raw) for _, raw in part]) - ORDER
        sums = np.concatenate([np.zeros((1, cost.shape[1])), np.cumsum(cost, axis=0, dtype=np.float64)])
        begins = np.concatenate([[0], ends[:-1] + ORDER])
        np.add.at(out, [k for k, _ in part], sums[ends] - sums[begins])

    def cost(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Bits of each symbol after its context, by language."""
        top = self.levels[-1]
        number = top.node[context]
        row = np.where(number >= 0, top.slot[np.maximum(number, 0) * _V + symbol], -1)
        cost = top.bits[row]  # rows of -1 are set below
        todo = np.flatnonzero(row < 0)
        known = number[todo] >= 0
        cost[todo] = np.where(known[:, None], top.escape[np.maximum(number[todo], 0)], 0)
        for order in range(ORDER - 1, -1, -1):
            if not len(todo):
                return cost
            level = self.levels[order]
            number = level.node[context[todo] % _V**order]
            row = np.where(number >= 0, level.slot[np.maximum(number, 0) * _V + symbol[todo]], -1)
            hit = row >= 0
            cost[todo[hit]] += level.bits[row[hit]]
            miss = ~hit
            cost[todo[miss]] += np.where((number[miss] >= 0)[:, None], level.escape[np.maximum(number[miss], 0)], 0)
            todo = todo[miss]
        cost[todo] += (8 - np.log2(_SPREAD[symbol[todo]]))[:, None].astype(np.float32)
        return cost


def compiled(languages: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray) -> Model:
    """From counts ``n`` of codes (``codes_of``) by number of a language."""
    levels: list[Level] = []
    size = len(languages)
    for order in range(ORDER + 1):
        own = code % _V ** (order + 1)
        pairs, back = np.unique(own, return_inverse=True)
        count = np.zeros((len(pairs), size))
        np.add.at(count, (back, lang), n)
        contexts, context = np.unique(pairs // _V, return_inverse=True)
        node = np.full(_V**order, -1, dtype=np.int32)
        node[contexts] = np.arange(len(contexts))
        total, distinct = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
        np.add.at(total, context, count)
        np.add.at(distinct, context, count > 0)
        slot = np.full(len(contexts) * _V, -1, dtype=np.int32)
        slot[context * _V + pairs % _V] = np.arange(len(pairs))
        share = np.where(total > 0, total + distinct, 1)
        escape = np.where(total > 0, -np.log2(np.maximum(distinct, 1) / share), 0)
        below = _below(levels, pairs // _V, pairs % _V, order, size)
        bits = np.where(count > 0, -np.log2(np.maximum(count, 1) / share[context]), escape[context] + below)
        levels.append(Level(node, slot, bits.astype(np.float32), escape.astype(np.float32)))
    return Model(languages, levels)


def _below(levels: list[Level], context: np.ndarray, symbol: np.ndarray, order: int, size: int) -> np.ndarray:
    """Bits of symbols after contexts of ``order`` as the next shorter ones give them; these have seen the symbols too."""
    if not order:
        return np.repeat((8 - np.log2(_SPREAD[symbol]))[:, None], size, axis=1)
    level = levels[order - 1]
    return level.bits[level.slot[level.node[context % _V ** (order - 1)].astype(np.int64) * _V + symbol]]


def train(rows: list[tuple[str, str]]) -> Model:
    """``rows``: (text, language). For tables see ``train_on``."""
    languages = sorted({lang for _, lang in rows})
    found = [np.unique(codes_of([t for t, x in rows if x == lang]), return_counts=True) for lang in languages]
    if not languages:
        return Model([], [])
    lang = np.repeat(np.arange(len(languages)), [len(c) for c, _ in found])
    return compiled(languages, lang, np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found]))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language, and its share of the likelihood, tempered by the length."""
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    raw = [_bytes(t) for t in texts]
    bits = model.lengths(raw)
    best = bits.argmin(axis=1)
    ahead = bits - bits[np.arange(len(bits)), best][:, None]
    ahead *= np.minimum(1, TEMPER / np.maximum([len(x) for x in raw], 1)).reshape(-1, 1)
    score = 1 / np.exp2(-np.minimum(ahead, 1000)).sum(axis=1)
    lang = [model.languages[b] if t is not None and _LETTER.search(t) else "und" for t, b in zip(texts, best, strict=True)]
    return lang, np.where(np.array(lang) == "und", 0.0, score) if texts else score


def held_out() -> Column:
    """Rows whose language is not learned."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on(docs: DataFrame, rows: int = ROWS) -> Model:
    """Fit on a hashed sample of each language. Counts of symbols after contexts come to the driver, never texts."""
    text_batches(docs.sparkSession)
    ready = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in ready.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], [])
    shares = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(sample_bound(rows / n)))])
    some = ready.where(positive_hash(F.lit(7), "doc_id", "text") <= shares[F.col("lang")])
    languages = sorted(sizes)
    number = {lang: k for k, lang in enumerate(languages)}

    def counted(batches):
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                code, n = np.unique(codes_of([t for t, x in zip(texts, langs, strict=True) if x == lang]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), number[lang], np.int32)), pa.array(code), pa.array(n)], ["lang", "code", "n"])

    counts = some.select("text", "lang").mapInArrow(counted, "lang int, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    lang, code, n = (table.column(c).to_numpy() for c in ("lang", "code", "n"))
    return compiled(languages, lang, code, n)


def report(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    text_batches(spark)
    sent = spark.sparkContext.broadcast(train_on(docs))

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        lang, score = predict(sent.value, list(texts))
        return pd.DataFrame({"lang_pred": lang, "score": score})

    rows = docs.select("doc_id", held_out().alias("held_out"), predicted("text").alias("x"))
    return rows.select("doc_id", "held_out", "x.lang_pred", "x.score")
