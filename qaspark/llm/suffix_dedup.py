"""Substring deduplication on bytes with sharded suffix arrays.

Every string of ``window`` bytes has a winnowed anchor, and equal strings share theirs, so
shards of anchors can be handled apart. Equal stretches around an anchor are told by their
key: all but the earliest go as a whole. A shard's text is made of the stretches around
anchors that have several different ones, each once, at its earliest place. Each
shard gets a suffix array by induced sorting and permuted common prefixes; suffixes that
agree over the whole window are one string, and only its earliest place stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import RUNS, anchored_runs, repeated_runs
from .common import dropped, mix, prepared, stored, struct_lists, texts_of, told_apart, with_names
from .substring_dedup import run_lists
from .suffix_array import permuted_prefixes, suffix_array

WINDOW = 100
GRAM = 20                      # bytes of an anchor
CHUNK = 1 << 20                # windows of a long text that are handled together
BLOCK = 1 << 15                # bytes of short texts that are handled together
SEND_BYTES = 1 << 20           # stretches that become one Arrow batch
SHARD_BYTES = 1 << 21          # text of a shard; it ends at the next anchor
HOT_KINDS = 20_000             # stretches of one anchor beyond which its windows are compared by Spark itself
BATCH = 128
SEGMENTS = "anchor long, doc_id long, first long, n int, bytes binary, hot boolean"
SPANS = "doc_id long, start long, end long"

_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _runs(data: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of a text; a very long one chunk by chunk, which cuts runs but loses no window."""
    parts = []
    for a in range(0, max(1, len(data)), CHUNK):
        piece = data[a:a + CHUNK + window - 1]
        _, anchor, run, first, n = anchored_runs(_CODE[piece], np.zeros(1, np.int64), np.array([len(piece)]), GRAM, window)
        parts.append((anchor, run, first + a, n))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _runs_of(texts: list[np.ndarray], window: int) -> pa.Array:
    """The runs of each text. Whole texts are handled together in blocks of about ``BLOCK`` bytes."""
    size = np.array([len(t) for t in texts], np.int64)
    found, number, i = [], np.zeros(len(texts), np.int64), 0
    while i < len(texts):
        j = i + max(1, int(np.searchsorted(np.cumsum(size[i:]), BLOCK, side="right")))
        if j == i + 1:
            runs = _runs(texts[i], window)
            number[i] = len(runs[0])
        else:
            begin = np.cumsum(size[i:j]) - size[i:j]
            sequence, *runs = anchored_runs(_CODE[np.concatenate(texts[i:j])], begin, size[i:j], GRAM, window)
            number[i:j] = np.bincount(sequence, minlength=j - i)
        found.append(runs)
        i = j
    offsets = np.concatenate(([0], np.cumsum(number))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), run_lists(found).values)


def _scan(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                s = b.slice(i, BATCH)
                texts = list(texts_of(s))
                n, sha = [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), _runs_of(texts, window)],
                                                 ["doc_id", "n_bytes", "sha", "runs"])
    return scan


def _segments(window: int):
    """The stretch of each run that is the earliest of its kind, if its anchor has other kinds."""
    def packed(held: list[tuple], parts: list[bytes]) -> pa.RecordBatch:
        anchor, doc, first, n, hot = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor, pa.int64()), pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int32()),
             pa.array(parts, pa.binary()), pa.array(hot.astype(bool), pa.bool_())],
            ["anchor", "doc_id", "first", "n", "bytes", "hot"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, size = [], [], 0
        for b in batches:
            for doc, runs, data in zip(b.column("doc_id").to_pylist(), struct_lists(b.column("runs")), texts_of(b)):
                own = np.flatnonzero(runs["earliest"].astype(bool) & runs["shared"].astype(bool))
                if not len(own):
                    continue
                first, n = runs["first"][own], runs["n"][own]
                end = first + n + window - 1
                whole = data.tobytes()
                held.append((runs["anchor"][own], np.full(len(own), doc), first, n, runs["hot"][own]))
                parts += [whole[s:e] for s, e in zip(first.tolist(), end.tolist())]
                size += int((end - first).sum())
                if size >= SEND_BYTES:
                    yield packed(held, parts)
                    held, parts, size = [], [], 0
        if held:
            yield packed(held, parts)
    return rows


def shard_repeats(doc: np.ndarray, first: np.ndarray, n: np.ndarray, parts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Spans ``(doc, start, end)`` of the windows of a shard that occur earlier in it.
    ``parts[i]`` holds windows 0 to ``n[i] - 1``, of which window 0 starts at ``first[i]``."""
    size = np.array([len(p) + 1 for p in parts])
    begin = np.cumsum(size) - size
    # 0 ends the text and 1 ends a stretch: bytes of UTF-8 are below 0xF5
    text = np.frombuffer(b"\xff".join(parts) + b"\xff\xfe", np.uint8) + np.uint8(2)
    sa = suffix_array(text, 256)
    shared = permuted_prefixes(text, sa, window, window)[sa] >= window
    shared[0] = False
    group = np.cumsum(~shared)
    repeated = shared | np.append(shared[1:], False)
    at, group = sa[repeated].astype(np.int64), group[repeated]
    part = np.searchsorted(begin, at, side="right") - 1
    inside = at - begin[part] < n[part]
    part, at, group = part[inside], at[inside], group[inside]
    where, place = doc[part], first[part] + at - begin[part]
    order = np.lexsort((place, where, group))
    later = order[1:][group[order][1:] == group[order][:-1]]
    where, place = where[later], place[later]
    order = np.lexsort((place, where))
    where, place = where[order], place[order]
    new = np.concatenate(([True], (where[1:] != where[:-1]) | (place[1:] > place[:-1] + 1)))[:len(where)]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(where)) - 1
    return where[start], place[start], place[end] + window if len(where) else place


def _shards(window: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            col = [t.column(c).to_numpy() for c in ("anchor", "doc_id", "first", "n")]
            once = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in col[:3]], axis=0)))   # repeated rows
            parts = t.column("bytes").filter(pa.array(once)).to_pylist()
            out = shard_repeats(col[1][once], col[2][once], col[3][once].astype(np.int64), parts, window)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "end"])
        bytes_, last = 0, None
        for b in batches:
            anchor = b.column("anchor").to_numpy()
            size = np.cumsum(b.column("bytes").to_pandas().str.len().to_numpy()) if len(anchor) else anchor
            cut = 0
            for i in [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist()] if len(anchor) else []:
                before = bytes_ + (int(size[i - 1]) if i else 0) - (int(size[cut - 1]) if cut else 0)
                if before >= SHARD_BYTES and (i or anchor[0] != last):
                    if i > cut:
                        held.append(b.slice(cut, i - cut))
                    yield flush()
                    cut, bytes_ = i, 0
            if len(anchor):
                held.append(b.slice(cut))
                bytes_ += int(size[-1]) - (int(size[cut - 1]) if cut else 0)
                last = anchor[-1]
        if held:
            yield flush()
    return solve


def _hot_windows(segments: DataFrame, window: int) -> DataFrame:
    """The same for anchors with too many stretches for one shard: their windows, grouped
    by Spark, partial aggregates first."""
    each = (segments.select("doc_id", "first", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
            .select("doc_id", (F.col("first") + F.col("j")).alias("start"),
                    F.expr(f"substring(bytes, j + 1, {window})").alias("w")))
    least = each.groupBy("w").agg(F.min(F.struct("doc_id", "start")).alias("least"))
    return (each.join(least, "w").filter(F.struct("doc_id", "start") > F.col("least"))
            .select("doc_id", "start", (F.col("start") + window).alias("end")))


def _remove(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, runs, spans, data in zip(b.column("doc_id").to_pylist(), struct_lists(b.column("runs")),
                                              struct_lists(b.column("spans")), texts_of(b)):
                edge = np.zeros(len(data) + 1, np.int32)
                copy = ~runs["earliest"].astype(bool)
                np.add.at(edge, runs["first"][copy], 1)
                np.add.at(edge, (runs["first"] + runs["n"])[copy] + window - 1, -1)
                np.add.at(edge, spans["start"], 1)
                np.add.at(edge, spans["end"], -1)
                gone = np.cumsum(edge[:-1]) > 0
                starts = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((doc, int(gone.sum()), starts, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                             ["doc_id", "n_removed", "n_spans", "kept"])
    return remove


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 hot_kinds: int = HOT_KINDS) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte goes if a string of ``window`` bytes that covers it also starts earlier (in a
    smaller id, or earlier in the same text); strings overlap freely, never cross texts
    and are judged on the input. Null, empty and short texts lose nothing; rows without
    id are matched with nothing; repeated rows (same id and text) are one document and
    get the same answer; different texts under one id are different documents, the one
    with the smaller digest first; an empty table gives no rows. ``window`` must be above
    ``GRAM``.
    """
    def scanned() -> DataFrame:
        return stored(texts.mapInArrow(_scan(window), f"doc_id long, n_bytes long, sha string, runs {RUNS}"), "byte-runs")
    texts, names = prepared(docs, id_col, text_col), None
    read = scanned()
    shas = read.groupBy("doc_id").agg(F.min("sha").alias("a"), F.max("sha").alias("b"))
    if not shas.filter("doc_id IS NOT NULL AND a <> b").isEmpty():
        dropped(read)
        texts, names = told_apart(texts)
        read = scanned()
    runs = read.filter("doc_id IS NOT NULL").select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*")
    counted = stored(read.select("doc_id", "n_bytes", "sha"), "byte-counts")
    found, parts = repeated_runs(runs, "byte-seeds")
    dropped(read)
    rows = found.select("doc_id", F.struct(
        "anchor", "first", "n", ((F.col("doc_id") == F.col("first_doc")) & (F.col("first") == F.col("first_at"))).alias("earliest"),
        (F.col("kinds") > 1).alias("shared"), (F.col("kinds") > hot_kinds).alias("hot")).alias("r"))
    matched = stored(texts.join(rows.groupBy("doc_id").agg(F.collect_list("r").alias("runs")).hint("shuffle_hash"), "doc_id"), "matched")
    for t in parts:
        dropped(t)
    segments = stored(matched.mapInArrow(_segments(window), SEGMENTS), "segments")
    shards = segments.filter("NOT hot").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "first")
    spans = (shards.mapInArrow(_shards(window), SPANS).unionByName(_hot_windows(segments.filter("hot"), window))
             .groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    removed = (matched.join(spans, "doc_id", "left").select("doc_id", "runs", "spans", "text")
               .mapInArrow(_remove(window), "doc_id long, n_removed long, n_spans long, kept string").dropDuplicates(["doc_id"]))
    out = (counted.join(removed, "doc_id", "left")
           .select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                   F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256")))
    return with_names(out, names)
