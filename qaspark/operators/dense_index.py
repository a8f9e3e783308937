"""An inverted-file index for dense retrieval, searched exactly.

Unit vectors are dealt to cells by distributed k-means. The vectors of a cell are kept in
slices, ordered by their angle to the cell's centroid, so a slice is a ring: all its angles
lie between two bounds. For a query at angle ``t`` from the centroid, the triangle
inequality on the sphere bounds the similarity of everything in a ring by ``cos`` of the
distance of ``t`` from those bounds. A search first scores the most promising slices of the
nearest cells, which gives every query a threshold, and then the slices that may still
reach it. No result is lost: slices are left out by proof. Slices and queries meet on the
grid of :func:`.retrieve._grid_top_k`, where a task tests the bounds itself, so no row is
ever made for a pair of query and slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..shipping import ship
from ..sources.folders import finished, shared_folder
from .retrieve import HITS, SLACK, _best, _dim, _final_top_k, _grid, _grid_top_k, _tiles, _unit_rows, each_with

MAX_CELLS = 4096               # bound of the centroids that reach the driver and the tasks
ROUNDS = 6                     # k-means rounds
SLICE_ROWS = 1024              # vectors of a slice
QUERY_ROWS = 1024              # queries scored at a time
QUERY_SALTS = 16               # parts over which the queries of one slice are spread
STEP_ROWS = 1024               # vectors compared with all centroids at a time
SLICES = "cell int, slice long, low double, high double, n int, payload binary"


def _ids_and_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("value"))


def _payload(ids: np.ndarray, rows: np.ndarray) -> bytes:
    """Ids and vectors of a slice as one Arrow stream."""
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1])],
                                       ["id", "value"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = pa.ipc.open_stream(payload).read_next_batch()
    return b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)


def _units(batch: pa.RecordBatch, dim: int, at: int = 1) -> np.ndarray:
    return _unit_rows(batch.column(at), max(dim, _dim(batch.column(at))))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose distances to ``MAX_CELLS`` centroids are few enough to hold."""
    for b in batches:
        for a in range(0, b.num_rows, STEP_ROWS):
            yield b.slice(a, STEP_ROWS)


def _angles(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centroids.T, -1.0, 1.0))


# ---------------------------------------------------------------- building

def _partial_means(centroids: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(centroids)
        for b in _steps(batches):
            u = _units(b, centroids.shape[1])
            u = u[u.any(axis=1)]
            np.add.at(total, (u @ centroids.T).argmax(axis=1), u)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].tolist(), pa.list_(pa.float64()))], ["cell", "total"])
    return add


def _add_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for c, row in zip(b.column(0).to_pylist(), b.column(1)):
            total[c] = total.get(c, 0.0) + row.values.to_numpy()
    keys = list(total)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[k].tolist() for k in keys], pa.list_(pa.float64()))],
                                     ["cell", "total"])


def fit_centroids(vectors: DataFrame, cells: int | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means over all of ``vectors(id, value)``. It starts
    from ``cells`` rows (the square root of their number by default, ``MAX_CELLS`` at most)
    chosen by a hash of the id; per round one partial sum per task and cell is added up."""
    usable = vectors.filter(F.exists("value", lambda x: x != 0))
    n = usable.count()
    cells = max(1, min(cells or int(n ** 0.5), MAX_CELLS, n))
    start = [r["value"] for r in usable.orderBy(F.xxhash64("id"), "id").limit(cells).collect()] if n else []
    if not start:
        return np.zeros((0, 1))
    centroids = np.unique(_unit_rows(pa.array(start, pa.list_(pa.float64())), len(start[0])), axis=0)
    for _ in range(rounds):
        parts = vectors.mapInArrow(_partial_means(centroids), "cell int, total array<double>")
        moved = centroids.copy()
        for r in parts.repartition("cell").mapInArrow(_add_totals, "cell int, total array<double>").collect():     # one row per cell
            v = np.array(r["total"])
            norm = np.linalg.norm(v)
            if norm > 0:
                moved[r["cell"]] = v / norm
        if np.abs(moved - centroids).max() < 1e-6:
            return moved
        centroids = moved
    return centroids


def _assign(centroids: np.ndarray):
    """Cell and angle of every vector; zero vectors go to cell -1."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            u = _units(b, centroids.shape[1])
            cell = np.full(len(u), -1, np.int32)
            angle = np.zeros(len(u))
            some = u.any(axis=1)
            if some.any():
                a = _angles(u[some], centroids)
                cell[some] = a.argmin(axis=1)
                angle[some] = a.min(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell), pa.array(angle), pa.array(list(u), pa.list_(pa.float64()))],
                                             ["id", "cell", "angle", "value"])
    return assign


def _slices(rows: int):
    """Packs rows sorted by (cell, angle) into slices where they lie."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            cell, angle, ids = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("cell", "angle", "id"))
            units = _units(b, 1, b.schema.get_field_index("value"))
            edges = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1 if len(cell) else 0)).tolist() + [len(cell)]
            for start, end in zip(edges, edges[1:]):
                for a in range(start, end, rows):
                    z = min(a + rows, end)
                    order = a + np.argsort(ids[a:z], kind="stable")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(cell[a])], pa.int32()), pa.array([number], pa.int64()), pa.array([angle[a:z].min()]),
                         pa.array([angle[a:z].max()]), pa.array([z - a], pa.int32()),
                         pa.array([_payload(ids[order], units[order])], pa.binary())],
                        ["cell", "slice", "low", "high", "n", "payload"])
                    number += 1
    return pack


class DenseIndex:
    """An index folder: ``centroids``, ``slices/batch=…`` (one per build or append) and
    ``zeros`` (ids of vectors without direction)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.schema("cell int, value array<double>").parquet(f"{self.path}/centroids").orderBy("cell").collect()
        self.centroids = np.array([r["value"] for r in rows]) if rows else np.zeros((0, 1))

    @classmethod
    def build(cls, corpus: DataFrame, id_col: str, vec_col: str, path: str | None = None, cells: int | None = None,
              rounds: int = ROUNDS) -> "DenseIndex":
        """Index ``corpus``. Null and empty vectors count as zero vectors; vectors of
        different lengths are an error."""
        spark = corpus.sparkSession
        path = (path or shared_folder(spark, "dense-index")).rstrip("/")
        vectors = _ids_and_vectors(corpus, id_col, vec_col)
        centroids = fit_centroids(vectors, cells, rounds)
        (spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, value array<double>")
         .coalesce(1).write.parquet(f"{path}/centroids"))
        index = cls(spark, path)
        index._add(vectors, 0)
        return index

    def append(self, corpus: DataFrame, id_col: str, vec_col: str) -> None:
        """Add rows to the cells as they stand; only the new rows are read."""
        batch = 0
        while finished(self.spark, f"{self.path}/slices/batch={batch}"):
            batch += 1
        self._add(_ids_and_vectors(corpus, id_col, vec_col), batch)

    def _add(self, vectors: DataFrame, batch: int) -> None:
        if len(self.centroids) == 0:                              # nothing but zero vectors so far
            centroids = np.eye(1, max(1, vectors.agg(F.max(F.size("value"))).first()[0] or 1))
            (self.spark.createDataFrame([(0, centroids[0].tolist())], "cell int, value array<double>")
             .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids"))
            self.centroids = centroids
        placed = vectors.mapInArrow(_assign(self.centroids), "id long, cell int, angle double, value array<double>")
        order = ["cell", "angle", "id"]
        (placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_slices(SLICE_ROWS), SLICES)
         .write.mode("overwrite").parquet(f"{self.path}/slices/batch={batch}"))

    # ------------------------------------------------------------ reading

    def slices(self) -> DataFrame:
        """All slices; a slice is named by its batch and number."""
        return (self.spark.read.schema(SLICES + ", batch int").parquet(f"{self.path}/slices")
                .withColumn("slice", F.struct("batch", "slice")).drop("batch"))

    def cells(self) -> DataFrame:
        """Per cell its vectors, slices and the bounds of its angles."""
        return self.slices().groupBy("cell").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("slices"),
                                                 F.min("low").alias("low"), F.max("high").alias("high"))

    def _near_cells(self, queries: DataFrame, k: int | None, cells: DataFrame) -> DataFrame:
        """``(query_id, cell, t)``: for each query the nearest cells that hold ``k``
        vectors, or (``k`` None) every cell that may reach the query's ``least``."""
        rows = {r["cell"]: (r["n"], r["low"], r["high"]) for r in cells.filter("cell >= 0").collect()}       # MAX_CELLS at most
        used = np.array(sorted(rows), np.int64)
        size = np.array([rows[c][0] for c in used.tolist()], np.int64)
        low, high = (np.array([rows[c][j] for c in used.tolist()]) for j in (1, 2))
        centroids = self.centroids

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _steps(batches):
                u = _units(b, centroids.shape[1])
                t = _angles(u, centroids[used])
                if k is None:
                    least = b.column(b.schema.get_field_index("least")).to_numpy(zero_copy_only=False)
                    away = np.maximum(np.maximum(low - t, t - high), 0.0)
                    take = np.cos(away) >= least[:, None] - SLACK
                else:
                    order = np.argsort(t, axis=1, kind="stable")
                    held = np.cumsum(size[order], axis=1) - size[order]
                    take = np.zeros(t.shape, bool)
                    np.put_along_axis(take, order, held < k, axis=1)
                take &= u.any(axis=1)[:, None]                    # zero queries have no direction
                i, j = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(used[j].astype(np.int32)), pa.array(t[i, j])],
                                                 ["query_id", "cell", "t"])
        columns = ["query_id", "value"] + (["least"] if k is None else [])
        return queries.select(*columns).mapInArrow(choose, "query_id long, cell int, t double")

    def _bound(self) -> Column:
        """Largest similarity that a vector of a slice can have with the query."""
        return F.cos(F.greatest(F.col("low") - F.col("t"), F.col("t") - F.col("high"), F.lit(0.0)))

    def _scored(self, probes: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """Top-k hits per query and slice for ``probes(query_id, value, slice)``."""
        dim = self.centroids.shape[1]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                part, number = b.column(0).field(0).to_numpy(), b.column(0).field(1).to_numpy()
                ids, units = b.column(1).to_numpy(), _units(b, dim, 2)
                edges = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (number[1:] != number[:-1])) + 1).tolist(), len(ids)] if len(ids) else [0]
                for start, end in zip(edges, edges[1:]):
                    for a in range(start, end, QUERY_ROWS):
                        z = min(a + QUERY_ROWS, end)
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(a, 1), pa.array([_payload(ids[a:z], units[a:z])], pa.binary())],
                                                         ["slice", "q"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for q, c in zip(b.column(0), b.column(1)):
                    q_ids, q_rows = _unpacked(q.as_py())
                    c_ids, c_rows = _unpacked(c.as_py())
                    s = np.round(c_rows @ q_rows.T, 12)
                    if exclude_self:
                        s[c_ids[:, None] == q_ids[None, :]] = -np.inf
                    value, ids = _best(s, c_ids, k)
                    keep = np.isfinite(value)
                    yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q_ids, value.shape)[keep], pa.int64()),
                                                      pa.array(ids[keep], pa.int64()), pa.array(value[keep])], ["query_id", "context_id", "score"])

        salt = F.pmod(F.xxhash64("query_id"), F.lit(QUERY_SALTS))
        tiles = (probes.select("slice", "query_id", "value").repartition("slice", salt).sortWithinPartitions("slice", "query_id")
                 .mapInArrow(pack, "slice struct<batch: int, slice: long>, q binary"))
        return tiles.join(self.slices().select("slice", "payload"), "slice").select("q", "payload").mapInArrow(score, HITS)

    def _probes(self, queries: DataFrame, k: int, exclude_self: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The cells, the first probes ``(query_id, slice)``, and the queries with the
        ``least`` score that their k-th hit reaches (by the hits of those probes)."""
        need = k + 1 if exclude_self else k
        cells = materialize(self.cells())
        meta = self.slices().select("cell", "slice", "low", "high", "n")
        best_first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "t", "slice").rowsBetween(Window.unboundedPreceding, -1)
        first = materialize(self._near_cells(queries, need, cells).join(meta, "cell").withColumn("bound", self._bound())
                            .withColumn("held", F.coalesce(F.sum("n").over(best_first), F.lit(0))).filter(F.col("held") < need)
                            .select("query_id", "slice"))
        hits = _final_top_k(self._scored(first.join(queries, "query_id"), k, exclude_self), k)
        least = hits.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        known = queries.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        return cells, first, materialize(known)

    def _reached(self, known: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """Hits of all slices that may reach the ``least`` score of a query."""
        spark, dim = self.spark, self.centroids.shape[1]
        rows = self.slices().filter("cell >= 0")
        # a tile number of its own for each slice; the top bits are those of the task that wrote it
        tiles = rows.select((F.col("slice.slice") + F.col("slice.batch")).alias("tile"), "payload", "cell", "low", "high")
        q = known.filter(F.exists("value", lambda x: x != 0)).select(F.col("query_id").alias("id"), "value", "least")
        grid = _grid(int(spark.conf.get("spark.sql.shuffle.partitions")), known.count(), rows.agg(F.sum("n")).first()[0] or 0, dim)
        return _grid_top_k(_tiles(q), tiles, grid, dim, k, exclude_self, self.centroids)

    def search(self, queries: DataFrame, query_id: str, query_vec: str, k: int = 3, exclude_self: bool = False) -> DataFrame:
        """The result of :func:`.retrieve.retrieve_dense` over all indexed rows:
        ``(query_id, rank, context_id, score)``, ties by id. Query ids should be unique:
        rows that repeat one are searched as one."""
        q = _ids_and_vectors(queries, query_id, query_vec).withColumnRenamed("id", "query_id").dropDuplicates(["query_id"])
        q = materialize(q)
        _, _, known = self._probes(q, k, exclude_self)
        found = self._reached(known, k, exclude_self)
        # score 0: zero vectors for every query, all vectors for a zero query; the first ids stand for them
        zeros = each_with(q, self._first_ids(F.col("cell") == -1, k + 1))
        nothing = q.filter(~F.coalesce(F.exists("value", lambda x: x != 0), F.lit(False)))
        anyone = each_with(nothing, self._first_ids(F.lit(True), k + 1))
        plain = zeros.unionByName(anyone).withColumn("score", F.lit(0.0)).distinct()
        if exclude_self:
            plain = plain.filter(F.col("query_id") != F.col("context_id"))
        return _final_top_k(found.unionByName(plain), k)

    def _first_ids(self, which: Column, n: int) -> list[int]:
        """The ``n`` smallest ids of the slices that ``which`` selects."""
        def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.empty(0, np.int64)
            for b in batches:
                for p in b.column(0):
                    best = np.sort(np.concatenate((best, _unpacked(p.as_py())[0])), kind="stable")[:n]
            yield pa.RecordBatch.from_arrays([pa.array(best)], ["context_id"])
        found = self.slices().filter(which).select("payload").mapInArrow(smallest, "context_id long")
        return [r["context_id"] for r in found.orderBy("context_id").limit(n).collect()]

    def probed(self, queries: DataFrame, query_id: str, query_vec: str, k: int = 3, exclude_self: bool = False) -> DataFrame:
        """What a search reads: ``(query_id, probed_cells, probed_slices, all_cells, all_slices)``."""
        q = materialize(_ids_and_vectors(queries, query_id, query_vec).withColumnRenamed("id", "query_id").dropDuplicates(["query_id"]))
        cells, first, known = self._probes(q, k, exclude_self)
        bounds = self.slices().select("cell", "slice", "low", "high")
        reach = (self._near_cells(known, None, cells).join(bounds, "cell").withColumn("bound", self._bound())
                 .join(known.select("query_id", "least"), "query_id").filter(F.col("bound") >= F.col("least") - SLACK))
        rest = reach.join(first, ["query_id", "slice"], "left_anti")
        meta = self.slices().filter("cell >= 0").select("slice", "cell")
        total = meta.agg(F.count_distinct("cell").alias("all_cells"), F.count(F.lit(1)).alias("all_slices")).first()
        return (first.unionByName(rest.select("query_id", "slice")).join(meta, "slice")
                .groupBy("query_id").agg(F.count_distinct("cell").alias("probed_cells"), F.count(F.lit(1)).alias("probed_slices"))
                .withColumn("all_cells", F.lit(total["all_cells"])).withColumn("all_slices", F.lit(total["all_slices"])))
