"""Benchmark decontamination by word-pair seeds and Smith-Waterman alignment.

Test items are a stated query set: they are taken in blocks of proven size, and each
block goes past the whole corpus. Seeds are pairs of words at distance 1 or 2. An
alignment of M words with X edits scores 2 M - X; between all but X / 2 of its M - 1
neighbouring words stands at most one edit, and each of these is a seed. So an item of m
words that reaches a share s of the perfect score 2 m shows seeds at s m - 1 places or
more, and a passage is aligned wherever that many lie close together: none that reaches
the wanted score is lost. One pass counts in how many documents each seed occurs. The
places of an item whose seeds are the most frequent are left out, and each lowers the
number wanted by one, so frequency decides the work and not the result. Documents are
never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import PLAIN_GAP, stored, texts_of, word_hashes, word_spans

DISTANCES = (1, 2)             # of the two words of a seed
SEEDS_WANTED = 4               # places of an item are left out until so many are wanted
MIN_SCORE = 0.5                # alignment score over that of a perfect copy
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 8 << 20          # text of the test items that are handled together
BLOCK_ITEMS = 50_000
ALIGN_CELLS = 4_000_000        # cells of alignments that are gathered before they run
ALIGN_WIDTH = 200_000          # window words of alignments that run side by side
HITS = "doc_id long, item_id long, score double, start long, end long"


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = word_spans(data, PLAIN_GAP)
    return word_hashes(data, starts, ends), starts, ends


_SECOND = np.uint64(0xD6E8FEB86659FD93)          # odd; sets the second word of a pair apart from the first
_SINGLE = np.uint64(0x94D049BB133111EB)          # sets single words apart from pairs


def _seeds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word pairs and the position of their first words. The distance is no
    part of a hash: words lost or added between two words leave their pair."""
    return (np.concatenate([h[:-k] + h[k:] * _SECOND for k in DISTANCES]),
            np.concatenate([np.arange(max(0, len(h) - k)) for k in DISTANCES]))


class _Block:
    """Items of one block: their words and their seeds, as sorted arrays."""

    def __init__(self, items: list[tuple[int, str]], min_score: float):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words = [_words(np.frombuffer(t.lower().encode(), np.uint8))[0] for _, t in items]
        size = np.array([len(h) for h in self.words], np.int64)
        self.edits = np.floor(2 * size * (1 - min_score) + 1e-9).astype(np.int64)      # of a passing alignment, at most
        self.want = np.maximum(1, np.ceil(min_score * size - 1 - 1e-9).astype(np.int64))
        self.single = (size > 0) & (min_score * size - 1 <= 1e-9)       # one word alone can pass
        gram, owner, pos = [], [], []
        for k, h in enumerate(self.words):
            g, p = (h * _SINGLE, np.arange(len(h))) if self.single[k] else _seeds(h)
            gram.append(g)
            owner.append(np.full(len(g), k, np.int64))
            pos.append(p.astype(np.int64))
        self._set(*(np.concatenate(x) for x in (gram, owner, pos)))

    def _set(self, gram: np.ndarray, owner: np.ndarray, pos: np.ndarray) -> None:
        o = np.argsort(gram, kind="stable")
        self.gram, self.owner, self.pos = gram[o], owner[o], pos[o]
        self.distinct = np.unique(self.gram)
        self.mask = np.uint64((1 << min(26, max(16, (64 * len(gram)).bit_length()))) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)         # most n-grams of a document end here
        self.maybe[self.distinct & self.mask] = True

    def leave_out(self, frequency: dict[int, int]) -> None:
        """Leave out the places of each item with the most frequent seeds."""
        df = np.array([frequency.get(int(g), 0) for g in self.distinct.view(np.int64)], np.int64)
        each = df[np.searchsorted(self.distinct, self.gram)]
        keep = np.ones(len(each), bool)
        by_item = np.argsort(self.owner, kind="stable")
        cuts = np.searchsorted(self.owner[by_item], np.arange(len(self.ids) + 1))
        for k in np.flatnonzero(self.want > SEEDS_WANTED).tolist():
            rows = by_item[cuts[k]:cuts[k + 1]]
            cost = np.bincount(self.pos[rows], weights=each[rows])
            out = np.argsort(-cost, kind="stable")[:self.want[k] - SEEDS_WANTED]
            keep[rows[np.isin(self.pos[rows], out)]] = False
            self.want[k] -= len(out)
        self._set(self.gram[keep], self.owner[keep], self.pos[keep])

    def document_seeds(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and positions of a document's n-grams that are seeds of the block."""
        if not len(h) or not len(self.gram):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        g, at = _seeds(h)
        if self.single.any():
            g, at = np.concatenate((g, h * _SINGLE)), np.concatenate((at, np.arange(len(h))))
        some = np.flatnonzero(self.maybe[g & self.mask])
        g, at = g[some], at[some]
        lo = np.searchsorted(self.distinct, g)
        found = np.flatnonzero(self.distinct[np.minimum(lo, len(self.distinct) - 1)] == g)
        return g[found], at[found]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, diagonal, position) of each seed of the block in a document."""
        g, at = self.document_seeds(h)
        lo = np.searchsorted(self.gram, g)
        n = np.searchsorted(self.gram, g, side="right") - lo
        row = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        return self.owner[row], at - self.pos[row], at


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of item/window pairs, side by side: best score and the end
    (exclusive, in window words) of that alignment. Linear gap costs."""
    m, n = max(map(len, items)), max(map(len, windows))
    a = np.zeros((len(items), m), np.uint64)
    b = np.zeros((len(items), n), np.uint64)
    for i, (x, y) in enumerate(zip(items, windows)):
        a[i, :len(x)], b[i, :len(y)] = x, y
    in_window = np.arange(n) < np.array([len(y) for y in windows])[:, None]
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    prev = np.zeros((len(items), n + 1), np.int64)
    ramp = -GAP * np.arange(n + 1)
    for j in range(m):
        real = np.array([j < len(x) for x in items])[:, None]
        same = (a[:, j:j + 1] == b) & in_window
        row = np.zeros_like(prev)
        row[:, 1:] = np.maximum(0, np.maximum(prev[:, :-1] + np.where(same, MATCH, MISMATCH), prev[:, 1:] + GAP))
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp           # gaps along the window
        row = np.where(real, row, 0)
        top = row.max(axis=1)
        better = top > best
        end[better] = row.argmax(axis=1)[better]
        best = np.maximum(best, top)
        prev = row
    return best, end


def _candidates(block: _Block, h: np.ndarray) -> list[tuple[int, int, int]]:
    """(item, first word, last word) windows of a document around the places where the
    wanted number of an item's seeds lie within the longest passage that can pass."""
    item, diagonal, at = block.hits(h)
    if not len(item):
        return []
    o = np.lexsort((at, item))
    item, diagonal, at = item[o], diagonal[o], at[o]
    first = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (at[1:] != at[:-1]))))
    own, place = item[first], at[first]                         # seeds at one place count once
    size = np.array([len(w) for w in block.words], np.int64)
    to = np.arange(len(own)) + block.want[own] - 1
    end = np.minimum(to, len(own) - 1)
    start = np.flatnonzero((to < len(own)) & (own[end] == own) & (place[end] - place < (size + block.edits)[own]))
    if not len(start):
        return []
    new = np.concatenate(([True], start[1:] > to[start[:-1]]))
    a, b = start[new], to[start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]]
    upto = np.append(first, len(item))
    out = []
    for f, t in zip(a.tolist(), b.tolist()):
        k = int(own[f])
        d = diagonal[upto[f]:upto[t + 1]]
        slack = int(block.edits[k])
        out.append((k, max(0, int(d.min()) - slack), min(len(h), int(d.max() + size[k]) + slack)))
    return out


def _aligned(block: _Block, pending: list[tuple]) -> Iterator[tuple]:
    """Forward score and end, backward score and end of each pending pair; pairs with
    windows of like length run side by side, so padding stays small."""
    order = sorted(pending, key=lambda p: len(p[3]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(order[to][3]) <= ALIGN_WIDTH:
            to += 1
        part = order[at:to]
        forward = align([block.words[p[2]] for p in part], [p[3] for p in part])
        backward = align([block.words[p[2]][::-1] for p in part], [p[3][::-1] for p in part])
        yield from zip(part, *(x.tolist() for x in (*forward, *backward)))
        at = to


def _lowered(b: pa.RecordBatch) -> pa.RecordBatch:
    text = pc.utf8_lower(pc.fill_null(b.column(1).cast(pa.large_string()), ""))
    return pa.RecordBatch.from_arrays([b.column(0), text], ["doc_id", "text"])


def _read_items(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The query set in blocks of at most ``BLOCK_ITEMS`` items and about ``BLOCK_BYTES``,
    one after the other; the driver holds one block at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = (benchmark.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
            .dropna().distinct().orderBy("i", "t"))
    for r in rows.toLocalIterator():
        if block and (size + len(r["t"]) > BLOCK_BYTES or len(block) >= BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id_col: str = "item_id", item_text_col: str = "text",
                       min_score: float = MIN_SCORE) -> DataFrame:
    """Passages of documents that align with a test item: ``doc_id, item_id, score, start,
    end`` (bytes of the lower-cased text), the best passage of each (document row, item).

    ``score`` is the alignment score over that of a perfect copy of the item; every passage
    with ``min_score`` (above 0) or more counts, so one word of a two-word item passes at
    0.5. Words are
    runs of letters, digits and non-ASCII characters, lower-cased. Items and documents
    without words (null, empty) match nothing; items without id are left out; repeated
    rows give repeated results; empty tables give no rows.
    """
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = spark.createDataFrame([], HITS)
    for items in _read_items(benchmark, item_id_col, item_text_col):
        block = _Block(items, min_score)
        counted = spark.sparkContext.broadcast(block)                   # at most a few times BLOCK_BYTES

        def count(batches: Iterator[pa.RecordBatch], shared=counted) -> Iterator[pa.RecordBatch]:
            blk = shared.value
            total = np.zeros(len(blk.distinct), np.int64)
            for b in batches:
                for t in texts_of(_lowered(b)):
                    total[np.searchsorted(blk.distinct, np.unique(blk.document_seeds(_words(t)[0])[0]))] += 1
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(blk.distinct[some].view(np.int64)), pa.array(total[some])], ["gram", "n"])

        frequency = {r["gram"]: r["n"] for r in texts.mapInArrow(count, "gram long, n long")
                     .groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator()}      # seeds of the block at most
        counted.unpersist()
        block.leave_out(frequency)
        seeds = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=seeds) -> Iterator[pa.RecordBatch]:
            blk = shared.value
            for b in batches:
                rows: list[tuple] = []
                pending: list[tuple] = []
                cells = 0

                def settle() -> None:
                    if not pending:
                        return
                    best: dict[tuple, tuple] = {}
                    for p, s, e, r, f in _aligned(blk, pending):
                        share = s / (MATCH * len(blk.words[p[2]]))
                        if share >= min_score:
                            begin = min(len(p[3]) - f, e - 1) if r == s else 0
                            row = (p[1], int(blk.ids[p[2]]), share, int(p[4][begin]), int(p[5][e - 1]))
                            if (p[0], p[2]) not in best or row[2] > best[p[0], p[2]][2]:
                                best[p[0], p[2]] = row
                    rows.extend(best.values())
                    pending.clear()

                for n, (doc, t) in enumerate(zip(b.column(0).to_pylist(), texts_of(_lowered(b)))):
                    h, starts, ends = _words(t)
                    if cells > ALIGN_CELLS:                             # between documents, so the best passage is known
                        settle()
                        cells = 0
                    for k, lo, hi in _candidates(blk, h):
                        pending.append((n, doc, k, h[lo:hi], starts[lo:hi], ends[lo:hi]))
                        cells += len(blk.words[k]) * (hi - lo)
                settle()
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                    ["doc_id", "item_id", "score", "start", "end"])

        out = out.unionByName(stored(texts.mapInArrow(search, HITS), "hits"))       # one block after the other
        seeds.unpersist()
    return out
