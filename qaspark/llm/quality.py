"""Quality classifier: naive Bayes support vectors.

Texts become indicators of hashed n-grams: of words (one and two) and of word shapes
(one to three; a shape says how a word is written and whether it repeats the one
before), with coarse shares of each shape. Indicators are scaled by the log ratio of
their class frequencies, a linear hinge-loss model is fitted by dual coordinate
descent, and its margins are calibrated to probabilities on rows kept out of the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import hashed_sample, mix, prepared, rolling, texts_of, word_hashes, word_spans

DIM = 1 << 18
MAX_TRAIN_DOCS = 6000          # labelled rows that are fitted on at most
MAX_TRAIN_FEATURES = 8_000_000  # and their indicators in total
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
CALIBRATION_SHARE = 5          # every fifth training row calibrates

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.int64)            # 0 other marks, 1 lower, 2 upper, 3 digit, 4 non-ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A small code for how each word is written."""
    code = np.zeros(len(starts), np.int64)
    for kind in range(5):
        seen = np.concatenate(([0], np.cumsum(_KIND[data] == kind, dtype=np.int32)))
        code = code * 3 + np.minimum(seen[ends] - seen[starts], 2)
    code = code * 4 + np.minimum(3, (ends - starts) // 4)
    code = code * 5 + _KIND[data[ends - 1]]
    again = np.concatenate(([False], hashes[1:] == hashes[:-1]))
    return (code * 2 + again).astype(np.uint64)


def indicators(data: np.ndarray) -> np.ndarray:
    """Sorted distinct feature ids (below ``DIM``) of one text's bytes; empty for no words."""
    starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, np.uint32)
    h = word_hashes(_LOWER[data], starts, ends)
    s = shapes(data, starts, ends, h)
    kinds, counts = np.unique(s, return_counts=True)
    share = (8 * counts // len(s)).astype(np.uint64)
    parts = [h, rolling(h, 2, 2), rolling(s, 1, 11), rolling(s, 2, 12), rolling(s, 3, 13),
             mix(kinds * np.uint64(16) + share + np.uint64(1 << 40))]
    return np.unique((np.concatenate(parts) % np.uint64(DIM)).astype(np.uint32))


@dataclass
class Model:
    """``weight[f]`` is model weight times log-count ratio, ``ratio[f]`` the ratio itself."""
    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        norm = float(np.sqrt(np.sum(self.ratio[ids] ** 2))) if len(ids) else 0.0
        return (float(np.sum(self.weight[ids])) / norm if norm else 0.0) + self.bias

    def score(self, ids: np.ndarray) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.slope * self.margin(ids) + self.shift, -50, 50))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log of (share of each indicator among positives / among negatives), smoothed."""
    count = [np.full(DIM, SMOOTHING), np.full(DIM, SMOOTHING)]
    for ids, label in zip(rows, y):
        count[int(label > 0)][ids] += 1
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss linear model over rows scaled by ``ratio`` to unit length, one dual
    variable at a time; both classes weigh the same in total."""
    values = [ratio[i] / max(float(np.sqrt(np.sum(ratio[i] ** 2))), 1e-12) for i in rows]
    w, bias = np.zeros(DIM), 0.0
    alpha = np.zeros(len(rows))
    n = len(rows)
    upper = np.where(y > 0, COST * n / (2 * max(1, (y > 0).sum())), COST * n / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(n):
            gradient = y[i] * (values[i] @ w[rows[i]] + bias) - 1.0
            new = min(max(alpha[i] - gradient / 2.0, 0.0), upper[i])      # |x|^2 + 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve of the margin (Newton steps, smoothed targets)."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * margins + b, -50, 50)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margins, d.sum()])
        hess = np.array([[h @ margins ** 2 + 1e-6, h @ margins], [h @ margins, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit and calibrate. Without both classes every text gets the smoothed share of label 1."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    zero = np.zeros(DIM, np.float32)
    if not len(y) or abs(y.sum()) == len(y):
        share = ((y > 0).sum() + 1.0) / (len(y) + 2.0)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    held = np.arange(len(y)) % CALIBRATION_SHARE == 0
    if len({*y[held]}) < 2 or len({*y[~held]}) < 2:
        held[:] = False
    train = ~held
    kept = [r for r, t in zip(rows, train) if t]
    ratio = log_count_ratio(kept, y[train])
    w, bias = dual_descent(kept, y[train], ratio)
    model = Model((w * ratio).astype(np.float32), ratio.astype(np.float32), bias, 1.0, 0.0)
    used = held if held.any() else train
    model.slope, model.shift = calibrate(np.array([model.margin(r) for r, u in zip(rows, used) if u]), y[used])
    return model


def _indicator_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([indicators(t).tobytes() for t in texts_of(b)], pa.binary())],
            ["doc_id", "label", "ids"])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is never learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", max_docs: int = MAX_TRAIN_DOCS,
                  max_features: int = MAX_TRAIN_FEATURES) -> Model:
    """Fit on at most ``max_docs`` labelled rows and ``max_features`` indicators outside
    fold 1, the first ones by a hash of their id. Rows without id, label or document are
    left out; an id with several labels counts by their mean."""
    chosen = (labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").alias("label"))
              .dropna().filter(fold(F.col("doc_id")) != 1)
              .groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label")))
    chosen = hashed_sample(chosen, "doc_id", max_docs)
    found = prepared(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")          # max_docs rows at most
    rows, labels_, total = [], [], 0
    got = found.select("doc_id", "label", "text").mapInArrow(_indicator_rows, "doc_id long, label int, ids binary")
    for r in got.orderBy(F.xxhash64("doc_id"), "doc_id", "ids").limit(max_docs).toLocalIterator():
        ids = np.frombuffer(r["ids"], np.uint32)
        if rows and total + len(ids) > max_features:
            break
        total += len(ids)
        rows.append(ids)
        labels_.append(r["label"])
    return fit(rows, np.array(labels_))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score`` (0 to 1). A null or empty text has no
    indicators and gets the model's score for that; ids pass through as they are."""
    texts = prepared(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)               # 2 MB, fixed

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([m.score(indicators(t)) for t in texts_of(b)], pa.float64())], ["doc_id", "score"])
    return texts.mapInArrow(score, "doc_id long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    scored = score_quality(docs, train_quality(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``least`` or more.
    Rows are judged where they are read, so nothing is shuffled."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            text = b.select([text_col]).set_column(0, text_col, b.column(text_col).fill_null(""))
            yield b.filter(pa.array([m.score(indicators(t)) >= least for t in texts_of(text, text_col)], pa.bool_()))
    return docs.mapInArrow(keep, docs.schema)
