"""Substring deduplication on words by seed and extend.

Seeds are winnowed anchors: every window of ``window`` words has one, and equal windows
share theirs. Anchors that occur at two places at least are joined, and each match is
extended to both sides as far as windows of the required length still agree: first whole
runs of windows, then, where runs of one anchor differ, window by window. Overlapping
matches merge into maximal repeats, whose words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import RUNS, repeated_runs, window_runs
from .common import dropped, prepared, stored, struct_lists, texts_of, told_apart, with_names, word_hashes, word_spans

WINDOW = 35
GRAM = 6                       # words of a seed
BATCH = 256                    # documents that become one Arrow batch


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray | None) -> str:
    """SHA-256 of the remaining words joined by one space."""
    words = data.tobytes().split()
    if gone is not None:
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scan(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                s = b.slice(i, BATCH)
                n, sha, runs = [], [], []
                for data in texts_of(s):
                    starts, ends = word_spans(data)
                    n.append(len(starts))
                    sha.append(_kept(data, starts, ends, None))
                    runs.append(window_runs(word_hashes(data, starts, ends), GRAM, window)[:4])
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n, pa.int64()), pa.array(sha), run_lists(runs)],
                                                 ["doc_id", "n_words", "sha", "runs"])
    return scan


def run_lists(runs: list[tuple[np.ndarray, ...]]) -> pa.Array:
    """One list of run structs for each document."""
    offsets = np.concatenate(([0], np.cumsum([len(r[0]) for r in runs]))).astype(np.int32)

    def flat(i: int, t: type) -> np.ndarray:
        return np.concatenate([r[i] for r in runs] or [np.empty(0)]).astype(t) if i > 1 else \
            np.concatenate([r[i] for r in runs] or [np.empty(0, np.uint64)]).view(np.int64)
    values = pa.StructArray.from_arrays([pa.array(flat(0, np.int64)), pa.array(flat(1, np.int64)),
                                         pa.array(flat(2, np.int64)), pa.array(flat(3, np.int32))], ["anchor", "run", "first", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _windows(window: int):
    """Hashes of the windows that must be compared one by one."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, runs, data in zip(b.column("doc_id").to_pylist(), struct_lists(b.column("runs")), texts_of(b)):
                own = runs["open"].astype(bool)
                if not own.any():
                    continue
                first, n = runs["first"][own], runs["n"][own].astype(np.int64)
                at = np.unique(np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                wh = window_runs(word_hashes(data, *word_spans(data)), GRAM, window)[4][at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc)), pa.array(at), pa.array(wh.view(np.int64))],
                                                 ["doc_id", "at", "window"])
    return rows


def _remove(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, sha = [], [], []
            for doc, runs, single, data in zip(b.column("doc_id").to_pylist(), struct_lists(b.column("runs")),
                                               b.column("single").to_pylist(), texts_of(b)):
                starts, ends = word_spans(data)
                edge = np.zeros(len(starts) + 1, np.int64)
                again = runs["again"].astype(bool)
                np.add.at(edge, runs["first"][again], 1)
                np.add.at(edge, (runs["first"] + runs["n"])[again] + window - 1, -1)
                at = np.array(single or (), np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                ids.append(doc)
                n.append(int(gone.sum()))
                sha.append(_kept(data, starts, ends, gone))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
                                             ["doc_id", "n_removed", "kept"])
    return remove


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256``.

    A word goes if a window of ``window`` words that covers it also starts anywhere else,
    in the same document or another; all windows are judged on the input. Words are runs
    without ASCII white space. Null, empty and short texts lose nothing; rows without id
    are matched with nothing; repeated rows (same id and text) are one document and get
    the same answer; different texts under one id are different documents; an empty table
    gives no rows. ``window`` must be above ``GRAM``.
    """
    texts, names = told_apart(prepared(docs, id_col, text_col))
    read = stored(texts.mapInArrow(_scan(window), f"doc_id long, n_words long, sha string, runs {RUNS}"), "word-runs")
    runs = read.filter("doc_id IS NOT NULL").select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*")
    counted = stored(read.select("doc_id", "n_words", "sha"), "word-counts")
    found, parts = repeated_runs(runs, "word-seeds")
    dropped(read)
    # runs that differ from others of their anchor: one document of each kind takes part
    rows = found.select("doc_id", F.struct("first", "n", "again", (
        (F.col("kinds") > 1) & (F.col("doc_id") == F.col("first_doc"))).alias("open")).alias("r"))
    matched = stored(texts.join(rows.groupBy("doc_id").agg(F.collect_list("r").alias("runs")).hint("shuffle_hash"), "doc_id"), "matched")
    for t in parts:
        dropped(t)
    windows = stored(matched.mapInArrow(_windows(window), "doc_id long, at long, window long"), "windows")
    twice = (windows.groupBy("window").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"),
                                           F.min("at").alias("a0"), F.max("at").alias("a1"))
             .filter("d0 < d1 OR a0 < a1").select("window"))
    single = windows.join(twice, "window", "left_semi").groupBy("doc_id").agg(F.collect_set("at").alias("single"))
    removed = (matched.join(single, "doc_id", "left").select("doc_id", "runs", "single", "text")
               .mapInArrow(_remove(window), "doc_id long, n_removed long, kept string").dropDuplicates(["doc_id"]))
    out = (counted.join(removed, "doc_id", "left")
           .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                   F.coalesce("kept", "sha").alias("kept_sha256")))
    return with_names(out, names)
