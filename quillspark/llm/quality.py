"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts train a logistic model on statistics of the whole
text by minimising the non-negative unbiased risk
``pi * R_pos(+) + max(0, R_unl(-) - pi * R_pos(-))``; where the second part is negative,
its gradient is reversed. The class prior ``pi`` is estimated from a first classifier of
labelled against unlabelled rows and its mean on trusted positives. A line through the
scores of labelled training rows of both classes calibrates the result.

About ``sample_rows`` positives, as many known negatives and as many unlabelled rows, or all
where there are fewer, are used for training: the labels are joined first, and each class is
picked by its own share of a hash, so few labels among many documents are all used. Rows count
by the inverse of that share, so they stand for the whole table. Every document is scored.

A null or empty text has zero for every statistic and gets a score too. Repeated rows
get equal scores. Labels that repeat for a doc_id count once, by the lowest. Without
labels of both kinds the calibration is left out. With fewer than two positives, or nothing
else, nothing can be learned: every score is the prior of 0.5, so none is predicted good, and
``keep_good`` keeps every document. An empty table gives an empty result.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, positive_hash, sample_bound, text_batches

log = logging.getLogger(__name__)

SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
_LOWER, _UPPER, _DIGIT, _BLANK, _LINE, _STOP, _SHOUT, _BAR, _MARK = range(9)


def _table() -> np.ndarray:
    of = {**{c: _UPPER for c in range(65, 91)}, **{c: _DIGIT for c in range(48, 58)}, 32: _BLANK, 9: _BLANK, 10: _LINE, 13: _LINE, **{ord(c): _STOP for c in ".,;:'\"()-?"}, ord("!"): _SHOUT, ord("|"): _BAR}
    return np.array([of.get(c, _LOWER if 97 <= c <= 122 or c > 127 else _MARK) for c in range(256)], dtype=np.uint8)


_KIND = _table()
N_FEATURES = 19


def statistics(text: str | None) -> np.ndarray:
    """Shares and means over the whole text."""
    out = np.zeros(N_FEATURES)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    kinds = _KIND[np.frombuffer(raw, dtype=np.uint8)]
    out[:9] = np.bincount(kinds, minlength=9) / len(kinds)
    words = raw.split()
    n = max(1, len(words))
    same = sum(map(bytes.__eq__, words[1:], words))
    distinct = set(words)
    out[9] = same / n
    out[10] = len(distinct) / n
    out[11] = np.log(len(distinct) + 1) / np.log(n + 2)
    out[12] = sum(map(len, words)) / n / 10
    out[13] = np.log1p(n) / 10
    # by line: shares of bytes in lines that shout, or are full of marks
    ends = np.append(np.flatnonzero(kinds == _LINE), len(kinds))
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    full = np.maximum(size, 1)

    def within(hit: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(hit)])
        return (sums[ends] - sums[starts]) / full

    out[14] = size[within(kinds == _UPPER) > 0.4].sum() / len(kinds)
    out[15] = size[within(kinds >= _SHOUT) > 0.06].sum() / len(kinds)
    lines = raw.split(b"\n")
    out[16] = 1 - len(set(lines)) / len(lines)
    out[17] = max(map(len, words), default=0) / len(raw)
    out[18] = np.log1p(len(lines)) / 10
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Statistics, their roots, and whether they are above a trace."""
    x = np.asarray(x, dtype=float).reshape(-1, N_FEATURES)
    return np.concatenate([x, np.sqrt(np.maximum(x, 0)), x > 0.02], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float
    prior: float
    learned: bool = True
    #: Rows that it was trained on: trusted positives, known negatives, unlabelled ones.
    positives: int = 0
    negatives: int = 0
    unlabelled: int = 0

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((expand(x) - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return _sigmoid(self.slope * z + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def _descend(gradient, size: int, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Adam."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _weights(weight: np.ndarray | None, n: int) -> np.ndarray:
    """Weights of mean 1."""
    return np.ones(n) if weight is None else weight / weight.mean()


def estimate_prior(pos: np.ndarray, unl: np.ndarray, pos_weight: np.ndarray | None = None, unl_weight: np.ndarray | None = None) -> float:
    """Share of positives in ``unl``: from P(labelled | x), whose mean on positives is P(labelled | positive)."""
    half = len(pos) // 2
    pw, uw = _weights(pos_weight, len(pos)), _weights(unl_weight, len(unl))
    x = np.concatenate([pos[:half], unl])
    y = np.concatenate([np.ones(half), np.zeros(len(unl))])
    each = np.concatenate([pw[:half], uw])
    w = _descend(lambda w: x.T @ (each * (_sigmoid(x @ w) - y)) / len(x) + 1e-3 * w, x.shape[1])
    labelled = np.average(_sigmoid(pos[half:] @ w), weights=pw[half:])
    return float(np.clip((uw * _sigmoid(unl @ w)).mean() / max(labelled, 1e-6), 0.05, 0.98))


def nn_pu(pos: np.ndarray, unl: np.ndarray, prior: float, decay: float = 1e-3, pos_weight: np.ndarray | None = None, unl_weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of least non-negative risk, with the logistic loss."""
    pw, uw = _weights(pos_weight, len(pos)), _weights(unl_weight, len(unl))

    def gradient(w):
        p, u = _sigmoid(pos @ w), _sigmoid(unl @ w)
        up = -prior * pos.T @ (pw * (1 - p)) / len(pos)
        rest = (uw * np.logaddexp(0, unl @ w)).mean() - prior * (pw * np.logaddexp(0, pos @ w)).mean()
        down = unl.T @ (uw * u) / len(unl) - prior * pos.T @ (pw * p) / len(pos)
        return (up + down if rest >= 0 else -down) + decay * w

    return _descend(gradient, pos.shape[1])


def fit(x: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """``label``: 1 trusted positive, 0 known negative (used for calibration alone), -1 none. ``weight``: rows that each stands for."""
    wide = expand(x)
    weight = _weights(weight, len(wide)) if len(wide) else np.zeros(0)
    mean, scale = np.zeros(3 * N_FEATURES), np.ones(3 * N_FEATURES)
    if len(wide):
        mean = np.average(wide, axis=0, weights=weight)
        scale = np.sqrt(np.average((wide - mean) ** 2, axis=0, weights=weight)) + 1e-6
    ready = _with_one((wide - mean) / scale)
    pos, unl = ready[label == 1], ready[label != 1]
    if len(pos) < 2 or not len(unl):
        return Model(mean, scale, np.zeros(ready.shape[1]), 1.0, 0.0, 0.5, learned=False)
    # what is unlabelled in the population includes the positives
    unl = np.concatenate([unl, pos])
    pos_weight, unl_weight = weight[label == 1], np.concatenate([weight[label != 1], weight[label == 1]])
    prior = estimate_prior(pos, unl, pos_weight, unl_weight)
    w = nn_pu(pos, unl, prior, pos_weight=pos_weight, unl_weight=unl_weight)
    known = label >= 0
    slope, shift = 1.0, 0.0
    if 0 < (label[known] == 1).sum() < known.sum():
        z = _with_one((ready[known] @ w)[:, None])
        y, each = label[known] == 1, _weights(weight[known], known.sum())
        slope, shift = _descend(lambda c: z.T @ (each * (_sigmoid(z @ c) - y)) / len(z), 2, steps=1500)
        slope = max(slope, 1e-3)
    return Model(mean, scale, w, float(slope), float(shift), prior)


def held_out() -> Column:
    """Rows whose label is not learned."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _described(rows: DataFrame) -> DataFrame:
    def described(batches):
        for batch in batches:
            x = [statistics(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "h", "label", "x"])

    return rows.select("doc_id", "h", "label", "text").mapInArrow(described, "doc_id long, h long, label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on hashed samples of each class of rows that are not held out; only statistics come to the driver."""
    text_batches(docs.sparkSession)
    known = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    # rows without a doc_id differ by their text
    ready = docs.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = ready.withColumn("h", positive_hash(F.lit(3), "doc_id", "text"))
    label = F.coalesce("label", F.lit(-1))
    sizes = {r["label"]: r["n"] for r in ready.select("doc_id").join(known, "doc_id", "left").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {k: min(1.0, sample_rows / n) for k, n in sizes.items()}
    bound = F.lit(-1).cast("long")
    for k, share in shares.items():
        bound = F.when(label == k, F.lit(sample_bound(share))).otherwise(bound)
    # ids meet the labels, and the few that are picked meet the texts, which are not shuffled
    widest = sample_bound(max(shares.values(), default=0.0))
    ids = keyed.where(F.col("h") <= widest).select("doc_id", "h").join(known, "doc_id", "left")
    picked = cut(ids.where(F.col("h") <= bound).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), label.alias("label")).distinct())
    rows = keyed.join(F.broadcast(picked), (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    # rows that repeat come once, with their number
    rows = _described(rows).groupBy("doc_id", "h").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.count(F.lit(1)).alias("n"))
    rows = rows.toPandas().sort_values(["h", "doc_id"])
    found = rows["label"].to_numpy(dtype=int)
    weight = rows["n"].to_numpy(dtype=float) / np.array([shares[k] for k in found.tolist()]).reshape(-1)
    model = fit(np.array(rows["x"].tolist()).reshape(-1, N_FEATURES), found, weight)
    model.positives, model.negatives, model.unlabelled = (int((found == k).sum()) for k in (1, 0, -1))
    told = f"{model.positives} positives, {model.negatives} known negatives and {model.unlabelled} unlabelled rows"
    if model.learned:
        log.info("trained on %s, prior %.3f", told, model.prior)
    else:
        log.warning("nothing could be learned from %s: every score is the prior", told)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Scores of a text column."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(np.array([statistics(t) for t in texts])) if len(texts) else [], dtype=float)

    return scored(F.col(text))


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    model = train(docs, labels)
    rows = docs.select("doc_id", held_out().alias("held_out"), score(docs, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    model = train(docs, labels)
    return docs.where(score(docs, model) >= threshold) if model.learned else docs
