"""Winnowed anchors of a sequence of codes (words or bytes).

Of the k-grams inside each window the one with the smallest hash is the window's anchor.
The choice depends on the window's content alone, so equal windows have equal anchors at
equal places. Consecutive windows with one anchor form a *run*; its key is a hash of all
the codes it covers and of the anchor's place, so equal runs are repeats of one stretch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_powers, dropped, mix, rolling, sliding_argmin, stored

#: Runs of a document: anchor hash, run key, first window, number of windows.
RUNS = "array<struct<anchor:bigint,run:bigint,first:bigint,n:int>>"


def window_runs(codes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, ...]:
    """``(anchor hash, run key, first window, windows, window hashes)`` of one sequence."""
    wh = rolling(codes, window, 77)
    if not len(wh):
        empty = np.empty(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, wh
    g = rolling(codes, gram, 33)
    anchor = sliding_argmin(g, window - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    n = np.diff(np.append(first, len(anchor)))
    at = anchor[first]
    # a run has at most `window` windows, so its first and last one cover all its codes
    key = mix(wh[first] ^ mix(wh[first + n - 1] + mix(((at - first) * 1000 + n).astype(np.uint64))))
    return g[at], key, first, n, wh


def anchored_runs(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, ...]:
    """``(sequence, anchor hash, run key, first window, windows)`` of all runs of several
    sequences, which lie one behind the other in ``codes``; windows lie within one sequence.
    All hashes come from one prefix sum. Hash and place of a gram share one number, so a
    plain minimum finds the anchor (the last of equals); the place within its window
    decides between hashes that differ in their lowest bits only."""
    n = len(codes) - window + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty
    power, inverse = code_powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[:-1], out=sums[1:])
    g = sums[gram:] - sums[:-gram]
    g *= inverse[:len(g)]
    g = mix(g)
    low = np.uint64((1 << len(g).bit_length()) - 1)
    best = (g | low) - np.arange(len(g), dtype=np.uint64)
    covered = 1
    while covered < window - gram + 1:
        step = min(covered, window - gram + 1 - covered)
        best = np.minimum(best[:-step], best[step:])
        covered += step
    stop = begin + np.maximum(size - window + 1, 0)
    edge = np.ones(n, bool)
    np.not_equal(best[1:], best[:-1], out=edge[1:])
    edge[begin[begin < n]] = True
    edge[stop[stop < n]] = True
    first = np.flatnonzero(edge)
    count = np.diff(np.append(first, n))
    sequence = np.searchsorted(begin, first, side="right") - 1
    inside = first < stop[sequence]                       # windows that begin in one sequence and end in another go
    first, count, sequence = first[inside], count[inside], sequence[inside]
    at = (low - (best[first] & low)).astype(np.int64)
    whole = (sums[first + count + window - 1] - sums[first]) * inverse[first]
    key = mix(mix(whole) + mix(((at - first) * 1000 + count).astype(np.uint64)))
    return sequence, g[at], key, first - begin[sequence], count


def repeated_runs(runs: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Of ``runs(doc_id, anchor, run, first, n)`` those whose anchor occurs at two places at
    least, with ``first_doc, first_at`` (the earliest place of an equal run), ``again``
    (whether an equal run is elsewhere) and ``kinds`` (different runs of that anchor).
    Counts are pre-aggregated by task; equal rows are one place. Also the stored tables that
    the result still reads."""
    # the small tables are written, so that the joins shuffle both sides and Spark can
    # split the rows of an anchor that very many documents share
    twice = stored(runs.groupBy("anchor").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"),
                                              F.min("first").alias("f0"), F.max("first").alias("f1"))
                   .filter("d0 < d1 OR f0 < f1").select("anchor"), f"{name}-anchors")
    held = stored(runs.join(twice, "anchor", "left_semi"), name)
    dropped(twice)
    kinds = (held.groupBy("anchor", "run")
             .agg(F.min(F.struct("doc_id", "first")).alias("lo"), F.max(F.struct("doc_id", "first")).alias("hi")))
    many = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    known = stored(kinds.join(many, "anchor")
                   .select("anchor", "run", F.col("lo.doc_id").alias("first_doc"), F.col("lo.first").alias("first_at"),
                           (F.col("lo") < F.col("hi")).alias("again"), "kinds"), f"{name}-kinds")
    return held.join(known, ["anchor", "run"]), [held, known]
