"""Pattern packing of token pieces into sequences of a fixed capacity.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. The
histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) decides the
packing: few-document length patterns are enumerated, their repeat counts fitted to the
histogram by non-negative least squares and rounded, and what is left over is packed
best-fit. Pieces are then numbered within their length and take the pattern slots in
that order, so assigning them is arithmetic on (length, number).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, stored
from .tokens import encoder, vocabulary_path

CAPACITY = 2048
END = 0                        # id that closes every document
MAX_DOCS = 8                   # documents in an enumerated pattern
FIT_STEPS = 400
WASTE = 0.01                   # patterns with more unused space are left to the residual packing
ROWS_PER_PART = 200_000        # pieces of one length that one task numbers
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _piece_rows(vocabulary: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path(vocabulary))
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(enc.encode(text.as_py()), END).astype("<u4")
                n = len(ids)
                at, size, piece = 0, n % capacity or min(n, capacity), 0
                while at < n:
                    out.append((doc, piece, at, size, zlib.crc32(ids[at:at + size])))
                    at, size, piece = at + size, capacity, piece + 1
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return cut


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: whole if it fits, else its first ``n mod capacity``
    ids (if any) and then runs of ``capacity``. A null text has the end id only."""
    return prepared(docs, id_col, text_col).mapInArrow(_piece_rows(vocabulary, capacity), PIECES)


# ---------------------------------------------------------------- the plan (driver, histogram only)

def enumerate_patterns(hist: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Few-document patterns over the lengths that occur, each length filled up by the
    longest that still fits: alone, after one copy, after several, and after each of
    some other lengths spread over the histogram."""
    have = np.flatnonzero(hist)
    fits = np.zeros(capacity + 1, np.int64)                    # longest length of at most s
    fits[have] = have
    fits = np.maximum.accumulate(fits)
    middle = np.unique(np.quantile(have, np.linspace(0, 1, 24)).astype(int))
    middle = np.unique(fits[middle])
    found = set()

    def fill(start: tuple[int, ...]) -> None:
        space = capacity - sum(start)
        if space < 0:
            return
        pattern = list(start)
        while len(pattern) < MAX_DOCS and fits[space] > 0:
            pattern.append(int(fits[space]))
            space -= pattern[-1]
        found.add(tuple(sorted(pattern, reverse=True)))

    for a in have.tolist():
        found.add((a,))
        fill((a,))
        for copies in (2, 3, 4):
            fill((a,) * copies)
        for b in middle.tolist():
            if b:
                fill((a, b))
    return sorted(found, reverse=True)


def fit_repeats(patterns: list[tuple[int, ...]], hist: np.ndarray, capacity: int) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ||A x - hist||^2 plus a small penalty on unused
    space, by accelerated projected gradient steps scaled per pattern."""
    width = max(map(len, patterns))
    slots = np.zeros((len(patterns), width), np.int64)         # length 0 pads: its count is ignored
    for i, p in enumerate(patterns):
        slots[i, :len(p)] = p
    waste = (capacity - slots.sum(1)) / capacity
    size = capacity + 1
    target = hist.astype(float)
    weight = 1.0 / np.maximum(target, 1.0)                     # relative errors of rare lengths count as well
    weight[0] = 0.0
    flat = slots.ravel()

    def apply(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights=np.repeat(x, width), minlength=size)

    used = apply(np.ones(len(patterns)))
    step = 1.0 / np.maximum((weight * used)[slots].sum(1) + waste ** 2, 1e-12)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(FIT_STEPS):
        r = weight * (apply(y) - target)
        nxt = np.maximum(0.0, y - step * (r[slots].sum(1) + waste))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def plan_patterns(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeats that use every piece of the histogram exactly once."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[tuple[int, ...], int]] = []
    if not left.any():
        return plan
    patterns = enumerate_patterns(left, capacity)
    x = np.floor(fit_repeats(patterns, left, capacity) + 1e-9).astype(np.int64)

    def take(pattern: tuple[int, ...], repeats: int) -> None:
        need = Counter(pattern)
        r = min([repeats, *(int(left[n]) // k for n, k in need.items())])
        if r > 0:
            for n, k in need.items():
                left[n] -= r * k
            plan.append((pattern, r))

    full = [i for i in np.flatnonzero(x).tolist() if capacity - sum(patterns[i]) <= WASTE * capacity]
    for i in sorted(full, key=lambda i: (capacity - sum(patterns[i]), i)):
        take(patterns[i], int(x[i]))
    while left.any():                                          # best fit, longest first
        space, pattern = capacity, []
        now = left.copy()
        while True:
            some = np.flatnonzero(now[:space + 1])
            if not len(some):
                break
            pattern.append(int(some[-1]))
            now[some[-1]] -= 1
            space -= int(some[-1])
        take(tuple(pattern), int(left[pattern[0]]))
    return plan


class _Slots:
    """Where the r-th piece of each length goes."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        rows = []
        base = 0
        for pattern, r in plan:
            offsets: dict[int, list[int]] = {}
            at = 0
            for n in pattern:
                offsets.setdefault(n, []).append(at)
                at += n
            rows += [(n, base, len(o), r, o) for n, o in offsets.items()]
            base += r
        rows.sort(key=lambda x: (x[0], x[1]))
        first, seen = [], Counter()
        for n, _, per, r, _ in rows:
            first.append(seen[n])
            seen[n] += per * r
        self.length = np.array([x[0] for x in rows], np.int64)
        self.first = np.array(first, np.int64)
        self.key = self.length << 48 | self.first
        self.base = np.array([x[1] for x in rows], np.int64)
        self.per = np.array([x[2] for x in rows], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.per)))[:-1] if rows else np.empty(0, np.int64)
        self.offset = np.array([o for x in rows for o in x[4]], np.int64)

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, length << 48 | number, side="right") - 1
        k = number - self.first[i]
        return self.base[i] + k // self.per[i], self.offset[self.at[i] + k % self.per[i]]


def _assign(slots: _Slots):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = slots.place(b.column("length").to_numpy(zero_copy_only=False),
                                   b.column("number").to_numpy(zero_copy_only=False))
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return assign


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece of the end id alone; null ids and repeated rows
    are packed like any others; an empty table gives no rows. Only the histogram of
    lengths reaches the driver. Pieces of one length are numbered in parts of about
    ``ROWS_PER_PART`` rows, each part after the earlier ones, so a length that a third
    of all pieces share is still numbered by many tasks.
    """
    pieces = stored(token_pieces(docs, id_col, text_col, vocabulary, capacity), "pieces")
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():       # at most `capacity` rows
        hist[r["length"]] = r["count"]
    slots = _Slots(plan_patterns(hist, capacity))
    parts = F.element_at(F.lit([int(-(-n // ROWS_PER_PART)) or 1 for n in hist]), (F.col("length") + 1).cast("int"))
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), parts.cast("long")))
    before = (parted.groupBy("length", "part").count()
              .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count"))
              .drop("count"))
    numbered = (parted.withColumn("own", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")))
                .join(before, ["length", "part"])
                .withColumn("number", F.col("before") + F.col("own") - 1)
                .select("doc_id", "piece", "start", "length", "ids_crc32", "number"))
    return numbered.mapInArrow(_assign(slots), PIECES + ", sequence_id long, offset long")
