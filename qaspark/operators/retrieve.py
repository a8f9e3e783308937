"""Top-k retrieval of contexts for queries.

Both retrievers are one distributed job. Queries and corpus rows are packed into tiles
(Arrow payloads of bounded rows and bytes). A task scores tile against tile with numpy and
keeps one running top-k per query, which it emits once per query tile; the final top-k is
a ``row_number() <= k`` that Spark plans as a WindowGroupLimit.

- Lexical: corpus tiles are dealt over the shuffle partitions, every query tile goes to
  each of them, and an equi-join on that number pairs them.
- Dense: query tiles are dealt over the rows of a grid and corpus tiles over its columns;
  a partition is one square, so a tile is copied about ``sqrt(partitions)`` times. Columns
  grow in number with the corpus, so a task holds a bounded share of it. Products in single
  precision leave out what surely misses the running top-k (by a bound of their error);
  only the rest is scored in double precision.

Nothing passes through the driver and nothing is broadcast, whatever the number of
queries. Ties are broken by corpus id ascending at every step, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..shipping import ship
from .skew import skew_join

TILE_ROWS = 2048                 # rows of a tile, and
TILE_BYTES = 512 << 10           # about as many bytes of vectors or tokens
MAX_EXPANSION = 4_000_000        # bound of one (text token -> query) expansion slice
FREQ_QUERIES = 32                # tokens in more queries of a tile than this use the dense product
MAX_DENSE_CELLS = 4_000_000      # bound of a tile's (tokens x queries) incidence matrix
ARGMAX_K = 16                    # up to this k the best rows are taken one after the other
COLUMN_BYTES = 64 << 20          # vectors of a dense corpus that a task holds, about
SEED_ROWS = 256                  # corpus rows scored in full before a query tile has its first top-k
SCORES = 1 << 20                 # bound of the similarities computed at a time
SLACK = 1e-9                     # rounding of bounds and scores
HITS = "query_id long, context_id long, score double"


# ---------------------------------------------------------------- tiles

def _tiles(df: DataFrame) -> DataFrame:
    """``(id, value)`` rows as tiles ``(tile, payload)``, packed where they lie; the rows of
    a tile are sorted by id."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            if not b.num_rows:
                continue
            rows = max(1, min(TILE_ROWS, int(b.num_rows * TILE_BYTES // max(1, b.nbytes))))
            for a in range(0, b.num_rows, rows):
                part = b.slice(a, rows)
                part = part.take(pc.sort_indices(part.column(0)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                                 ["tile", "payload"])
                n += 1
    return df.mapInArrow(pack, "tile long, payload binary")


def _unpack(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query (column) the k best rows, score descending then id ascending, as
    ``(scores, ids)`` of shape (k, queries); rows are sorted by id. Consumes ``score``."""
    k = min(k, score.shape[0])
    if k > ARGMAX_K:
        order = np.argsort(-score, axis=0, kind="stable")[:k]
        return np.take_along_axis(score, order, axis=0), ids[order]
    columns = np.arange(score.shape[1])
    values, rows = [], []
    for _ in range(k):
        at = score.argmax(axis=0)                        # the first of equals: the smallest id
        values.append(score[at, columns])
        rows.append(ids[at])
        score[at, columns] = -np.inf
    return np.array(values), np.array(rows)


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    score, ids = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.lexsort((ids, -score), axis=0)[:k]
    return np.take_along_axis(score, order, axis=0), np.take_along_axis(ids, order, axis=0)


def _search(queries: DataFrame, corpus: DataFrame, k: int, tile_of: Callable) -> DataFrame:
    """Top-k of ``corpus(id, value)`` for each of ``queries(id, value)``. ``tile_of`` makes
    a scorer of an unpacked query tile: ``scorer(corpus batch) -> (rows x queries)`` scores."""
    spark = ship(corpus.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = _tiles(queries).select(F.col("tile").alias("q_tile"), F.col("payload").alias("q"),
                               F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    c = _tiles(corpus).select(F.pmod(F.xxhash64("tile"), F.lit(parts)).cast("int").alias("part"), F.col("payload").alias("c"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scorer, q_ids, best = None, None, None, None

        def done() -> pa.RecordBatch:
            keep = np.isfinite(best[0])
            ids = np.broadcast_to(q_ids, best[0].shape)
            return pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(best[1][keep], pa.int64()),
                                               pa.array(best[0][keep], pa.float64())], ["query_id", "context_id", "score"])
        for b in batches:
            for tile, q_payload, c_payload in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if tile != now:
                    if best is not None:
                        yield done()
                    batch = _unpack(q_payload.as_py())
                    now, best = tile, None
                    q_ids, scorer = batch.column(0).to_numpy().astype(np.int64), tile_of(batch)
                texts = _unpack(c_payload.as_py())
                ids = texts.column(0).to_numpy().astype(np.int64)
                found = _best(scorer(texts), ids, k)
                best = found if best is None else _merge(best, found, k)
        if best is not None:
            yield done()

    return _final_top_k(q.join(c.hint("merge"), "part").select("q_tile", "q", "c").mapInArrow(score, HITS), k)


def _final_top_k(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("context_id").asc())
    return (hits.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "context_id", "score"))


# ---------------------------------------------------------------- dense

def _unit_rows(col: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix of unit rows; a null or empty vector is a zero row, and
    vectors of another length are an error."""
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    if ((size != 0) & (size != dim)).any():
        raise ValueError("embeddings of different lengths cannot be compared")
    m = np.zeros((len(col), dim))
    m[size > 0] = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    n = np.linalg.norm(m, axis=1)
    return np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0)


def _dim(*cols: pa.Array) -> int:
    return max([1, *(int(pc.max(pc.list_value_length(c)).as_py() or 0) for c in cols)])


class _Nearest:
    """The ``k`` best rows so far for each query of a tile. ``least`` (per query) is a
    score that its k-th best row is known to reach."""

    def __init__(self, ids: np.ndarray, units: np.ndarray, k: int, exclude_self: bool, least: np.ndarray | None = None):
        self.ids, self.units, self.low, self.k, self.exclude_self = ids, units, units.astype(np.float32), k, exclude_self
        self.value = np.full((k, len(ids)), -np.inf)
        self.row = np.full((k, len(ids)), np.iinfo(np.int64).max)
        self.least = np.full(len(ids), -np.inf) if least is None else least
        # error of a product of unit vectors in single precision, with room to spare
        self.slack = (units.shape[1] + 8) * 2.0 ** -22

    def floor(self, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Scores below this cannot enter the top-k any more."""
        return np.maximum(self.value[-1, of], self.least[of])

    def add(self, ids: np.ndarray, units: np.ndarray, low: np.ndarray, of: np.ndarray | None = None) -> None:
        """Score corpus rows, sorted by id, against the queries ``of`` (all of them by default)."""
        of = np.arange(len(self.ids)) if of is None else of
        narrow = self.low if len(of) == len(self.ids) else self.low[of]
        step, a = max(1, SCORES // max(1, len(of))), 0
        while a < len(ids) and len(of):
            floor = self.floor(of)
            if np.isneginf(floor).any():                        # no k rows seen yet: a short block, in full
                z = a + min(SEED_ROWS, step)
                self._add_all(ids[a:z], units[a:z], of)
            else:
                z = a + step
                s = low[a:z] @ narrow.T
                at = np.flatnonzero(s >= (floor - self.slack).astype(np.float32))
                if len(at) > s.size // 16:                      # many near ties
                    for b in range(a, min(z, len(ids)), SEED_ROWS):
                        self._add_all(ids[b:min(b + SEED_ROWS, z)], units[b:min(b + SEED_ROWS, z)], of)
                elif len(at):
                    r, j = np.divmod(at, len(of))
                    score = np.round(np.einsum("ij,ij->i", units[a + r], self.units[of[j]]), 12)
                    self._add_some(of[j], ids[a + r], score)
            a = z

    def _add_all(self, ids: np.ndarray, units: np.ndarray, of: np.ndarray) -> None:
        # rounded, so that equal vectors tie whatever the shape of the product
        s = np.round(units @ self.units[of].T, 12)
        s[np.isnan(s)] = -np.inf
        if self.exclude_self:
            s[ids[:, None] == self.ids[of][None, :]] = -np.inf
        self.value[:, of], self.row[:, of] = _merge((self.value[:, of], self.row[:, of]), _best(s, ids, self.k), self.k)

    def _add_some(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Single scores of queries (by place in the tile) and rows."""
        keep = score >= self.floor(query)
        if self.exclude_self:
            keep &= ids != self.ids[query]
        query, ids, score = query[keep], ids[keep], score[keep]
        if not len(query):
            return
        touched, place = np.unique(query, return_inverse=True)
        group = np.concatenate((np.tile(np.arange(len(touched)), self.k), place))
        value = np.concatenate((self.value[:, touched].ravel(), score))
        row = np.concatenate((self.row[:, touched].ravel(), ids))
        order = np.lexsort((row, -value, group))
        first = np.searchsorted(group[order], np.arange(len(touched)))
        best = order[first[None, :] + np.arange(self.k)[:, None]]
        self.value[:, touched], self.row[:, touched] = value[best], row[best]

    def hits(self) -> pa.RecordBatch:
        keep = np.isfinite(self.value)
        ids = np.broadcast_to(self.ids, self.value.shape)
        return pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(self.row[keep], pa.int64()),
                                           pa.array(self.value[keep], pa.float64())], ["query_id", "context_id", "score"])


def _grid(parts: int, queries: int, corpus: int, dim: int) -> tuple[int, int]:
    """Rows (of query tiles) and columns (of corpus tiles) of the grid: about ``parts``
    squares, more if the vectors of a column would pass ``COLUMN_BYTES``."""
    rows = max(1, min(-(-queries // TILE_ROWS), round(parts ** 0.5)))
    columns = max(1, min(-(-corpus // SEED_ROWS), -(-parts // rows)), -(-corpus * dim * 8 // COLUMN_BYTES))
    return rows, columns


def _dealt(tile: str, n: int) -> Column:
    """The tiles of a partition in turn over ``n`` numbers, from a start of its own."""
    return F.pmod(F.xxhash64(F.shiftright(tile, 32)) % n + F.col(tile).bitwiseAND((1 << 32) - 1), F.lit(n)).cast("int")


def _grid_top_k(queries: DataFrame, corpus: DataFrame, grid: tuple[int, int], dim: int, k: int, exclude_self: bool,
                centroids: np.ndarray | None = None) -> DataFrame:
    """Hits, at most ``k`` per query and column, of ``corpus(tile, payload, cell, low, high)``
    for ``queries(tile, payload)``. A query payload may have a third column, the ``least``
    score of each query; with ``centroids`` a corpus tile is a ring of angles around the
    centroid of its cell and is left out for the queries whose top-k it cannot enter."""
    rows, columns = grid
    every = F.lit(None)
    c = corpus.select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"), _dealt("tile", columns).alias("c"),
                      F.lit(0).alias("side"), "tile", "payload", "cell", "low", "high")
    q = queries.select(_dealt("tile", rows).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"),
                       F.lit(1).alias("side"), "tile", "payload", every.cast("int").alias("cell"),
                       every.cast("double").alias("low"), every.cast("double").alias("high"))
    squares = (c.unionByName(q).repartitionById(rows * columns, (F.col("r") * columns + F.col("c")).cast("int"))
               .sortWithinPartitions("side", "tile").select("side", "payload", "cell", "low", "high"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []             # a column's share of the corpus
        rings: list[tuple[int, float, float]] = []
        for b in batches:
            for side, payload, *ring in zip(*(b.column(i) for i in range(5))):
                t = _unpack(payload.as_py())
                ids, units = t.column(0).to_numpy().astype(np.int64), _unit_rows(t.column(1), dim)
                if side.as_py() == 0:
                    held.append((ids, units, units.astype(np.float32)))
                    rings.append(tuple(x.as_py() for x in ring))
                    continue
                least = t.column(2).to_numpy(zero_copy_only=False) if t.num_columns > 2 else None
                best = _Nearest(ids, units, k, exclude_self, least)
                if centroids is None:
                    for tile in held:
                        best.add(*tile)
                else:
                    used, at = np.unique([r[0] for r in rings], return_inverse=True)
                    angle = np.arccos(np.clip(units @ centroids[used.astype(np.int64)].T, -1.0, 1.0))
                    for tile, (_, low, high), j in zip(held, rings, at.tolist()):
                        bound = np.cos(np.maximum(np.maximum(low - angle[:, j], angle[:, j] - high), 0.0))
                        best.add(*tile, np.flatnonzero(bound >= best.floor() - SLACK))
                yield best.hits()
    return squares.mapInArrow(score, HITS)


def _vectors(df: DataFrame, i: str, v: str) -> DataFrame:
    """``(id, value)``; single-precision vectors travel as they are."""
    kind = df.select(F.col(v)).schema[0].dataType.simpleString()
    return df.select(F.col(i).cast("long").alias("id"), F.col(v).cast(kind if kind == "array<float>" else "array<double>").alias("value"))


def retrieve_dense(queries: DataFrame, corpus: DataFrame, query_id: str, query_vec: str,
                   corpus_id: str, corpus_vec: str, k: int = 3, exclude_self: bool = False) -> DataFrame:
    """Top-k corpus rows per query by cosine similarity (0 when a norm is 0).

    Returns ``(query_id, rank, context_id, score)``; ``exclude_self`` drops a
    corpus row whose id equals the query id (for a table searched against
    itself). Query ids should be unique: rows that repeat one are searched as one.
    """
    spark = ship(corpus.sparkSession)
    q, c = _vectors(queries, query_id, query_vec), _vectors(corpus, corpus_id, corpus_vec)
    (n_q, dim_q), (n_c, dim_c) = (df.agg(F.count(F.lit(1)), F.max(F.size("value"))).first() for df in (q, c))
    dim = max(1, dim_q or 1, dim_c or 1)
    ring = [F.lit(None).cast(t).alias(n) for n, t in (("cell", "int"), ("low", "double"), ("high", "double"))]
    grid = _grid(int(spark.conf.get("spark.sql.shuffle.partitions")), n_q, n_c, dim)
    return _final_top_k(_grid_top_k(_tiles(q), _tiles(c).select("*", *ring), grid, dim, k, exclude_self), k)


# ---------------------------------------------------------------- lexical

class _LexicalTile:
    """The tokens of a query tile, ready to count shared tokens with many texts."""

    def __init__(self, batch: pa.RecordBatch, often_from: int, expansion: int):
        self.expansion = expansion
        lists = batch.column(1)
        self.n = batch.num_rows
        self.sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.float64)
        flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        owner = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        self.vocab = pd.Index(pd.unique(flat))
        token = self.vocab.get_indexer(flat).astype(np.int64)
        order = np.argsort(token, kind="stable")
        self.owner = owner[order]
        self.start = np.searchsorted(token[order], np.arange(len(self.vocab) + 1))
        # tokens shared by many queries are counted by a dense matrix product
        per_token = np.diff(self.start)
        often = np.flatnonzero(per_token > often_from)
        room = MAX_DENSE_CELLS // max(1, self.n)
        often = often[np.argsort(-per_token[often], kind="stable")[:room]]
        self.column = np.full(len(self.vocab), -1, np.int64)
        self.column[often] = np.arange(len(often))
        self.incidence = np.zeros((len(often), self.n), np.float32)
        for i, t in enumerate(often.tolist()):
            self.incidence[i, self.owner[self.start[t]:self.start[t + 1]]] = 1.0

    def __call__(self, texts: pa.RecordBatch) -> np.ndarray:
        lists = texts.column(1)
        rows = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        token = self.vocab.get_indexer(pc.list_flatten(lists).to_numpy(zero_copy_only=False))
        rows, token = rows[token >= 0], token[token >= 0]
        count = np.zeros(len(lists) * self.n)
        dense = self.column[token] >= 0
        if dense.any():
            # tokens of a text are distinct, so presence is 0/1; float32 products of small integers are exact
            present = np.zeros((len(lists), self.incidence.shape[0]), np.float32)
            present[rows[dense], self.column[token[dense]]] = 1.0
            count += (present @ self.incidence).ravel()
            rows, token = rows[~dense], token[~dense]
        length = self.start[token + 1] - self.start[token]
        ends = np.cumsum(length)
        lo = 0
        while lo < len(token):                           # slices of bounded expansion
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + self.expansion, side="right")))
            n = length[lo:hi]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[token[lo:hi]], n)
            count += np.bincount(np.repeat(rows[lo:hi], n) * self.n + self.owner[at], minlength=len(count))
            lo = hi
        count = count.reshape(len(lists), self.n)
        return np.divide(count, self.sizes[None, :], out=np.zeros_like(count), where=self.sizes[None, :] > 0)


def retrieve_lexical(queries: DataFrame, corpus: DataFrame, query_id: str, query_text: str,
                     corpus_id: str, corpus_text: str, k: int = 3) -> DataFrame:
    """Top-k corpus texts per query by token recall of the query in the text
    (``|Q n D| / |Q|``; 0 for a query without words).

    Tokens are computed JVM-side; tasks map a tile's tokens onto the vocabulary of a
    query tile and count the shared ones with numpy.
    Returns ``(query_id, rank, context_id, score)``.
    """
    def side(df: DataFrame, i: str, t: str) -> DataFrame:
        return df.select(F.col(i).cast("long").alias("id"), tokens(F.col(t)).alias("value"))
    return _search(side(queries, query_id, query_text), side(corpus, corpus_id, corpus_text), k,
                   partial(_LexicalTile, often_from=FREQ_QUERIES, expansion=MAX_EXPANSION))


# ---------------------------------------------------------------- the lexical index

def build_postings(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """U4: the lexical index -- one ``(token, context_id)`` row per distinct
    token of each corpus text (write it as parquet to keep it)."""
    return corpus.select(F.col(id_col).alias("context_id"),
                         F.explode(tokens(F.col(text_col))).alias("token"))


def index_size(postings: DataFrame) -> DataFrame:
    """U4 size: postings rows, distinct tokens and token bytes of the index."""
    return postings.agg(F.count(F.lit(1)).cast("bigint").alias("postings"),
                        F.count_distinct("token").cast("bigint").alias("tokens"),
                        F.sum(F.octet_length("token")).cast("bigint").alias("token_bytes"))


def retrieve_from_index(queries: DataFrame, postings: DataFrame, corpus_ids: DataFrame, query_id: str, query_text: str,
                        corpus_id: str, k: int = 3) -> DataFrame:
    """The result of :func:`retrieve_lexical` from a kept index (:func:`build_postings`).

    Only postings of query tokens are joined (hot tokens salted) and shared tokens are
    counted per (query, text). Texts that share nothing score 0: the ``k`` smallest ids
    of ``corpus_ids`` stand in for them, which is all that a top-k can show.
    """
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), tokens(F.col(query_text)).alias("toks"))
    words = q.select("query_id", F.size("toks").alias("n"), F.explode("toks").alias("token"))
    shared = (skew_join(postings.select("token", "context_id"), words, ["token"])
              .groupBy("query_id", "context_id").agg((F.count(F.lit(1)) / F.max("n")).alias("score")))
    least = corpus_ids.select(F.col(corpus_id).cast("long").alias("context_id")).orderBy("context_id").limit(k)
    none = q.select("query_id").join(F.broadcast(least), F.lit(True)).withColumn("score", F.lit(0.0))      # k rows
    both = shared.unionByName(none).groupBy("query_id", "context_id").agg(F.max("score").alias("score"))
    return _final_top_k(both, k)


def each_with(queries: DataFrame, ids: list[int]) -> DataFrame:
    """``(query_id, context_id)``: every query with each of a few ids (k of them or so)."""
    few = F.array(*[F.lit(i) for i in ids]).cast("array<long>")
    return queries.select("query_id", F.explode(few).alias("context_id"))


def attach_contexts(retrieved: DataFrame, corpus: DataFrame, corpus_id: str, corpus_text: str,
                    k: int) -> DataFrame:
    """Retrieval results as prompt contexts: ``(query_id, contexts, scores)``
    with the texts of each query's top-``k`` corpus rows in rank order.

    ``retrieved`` is the top-k output of a retriever (at most ``k`` rows per
    query), so each collected list is bounded by ``k``.
    """
    hits = (retrieved.filter(F.col("rank") <= k)
            .join(corpus.select(F.col(corpus_id).alias("context_id"), F.col(corpus_text).alias("__ctx")),
                  on="context_id", how="inner"))
    g = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "__ctx", "score"))).alias("__hits"))
    return g.select("query_id", F.transform("__hits", lambda h: h["__ctx"]).alias("contexts"),
                    F.transform("__hits", lambda h: h["score"]).alias("scores"))
