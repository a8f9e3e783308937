"""The inverted-file index: searched exactly, whatever it leaves out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaspark.operators import dense_index
from qaspark.operators.dense_index import DenseIndex, fit_centroids
from qaspark.operators.retrieve import retrieve_dense
from tests.conftest import SF_SMALL


def _clusters(n, centres, seed, spread=0.05, dim=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return [(i, (c[i % centres] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(5)


def _plain(queries, corpus, k, exclude_self):
    """(query, rank) -> (context, score) by the rule itself."""
    def unit(v):
        v = np.array(v or [0.0] * 12, float)
        n = np.linalg.norm(v)
        return v / n if n else v
    c = {i: unit(v) for i, v in corpus}
    out = {}
    for q, v in queries:
        score = sorted((-round(float(unit(v) @ x), 10) + 0.0, i) for i, x in c.items() if not (exclude_self and i == q))
        for r, (s, i) in enumerate(score[:k], 1):
            out[q, r] = (i, -s)
    return out


def _rows(df):
    rows = df.collect()
    out = {(r["query_id"], r["rank"]): (r["context_id"], r["score"]) for r in rows}
    assert len(out) == len(rows)
    return out


def _equal(got, want):
    assert {q: c for q, (c, _) in got.items()} == {q: c for q, (c, _) in want.items()}
    assert all(abs(got[q][1] - want[q][1]) < 1e-9 for q in want)


@pytest.mark.parametrize("exclude_self,k", [(True, 3), (False, 1), (False, 20)])
def test_search_is_exact(spark, monkeypatch, exclude_self, k):
    monkeypatch.setattr(dense_index, "SLICE_ROWS", 6)
    monkeypatch.setattr(dense_index, "QUERY_ROWS", 5)
    rows = _clusters(300, 7, 1)
    rows += [(300 + i, rows[i][1]) for i in range(40)]                   # equal vectors tie
    rows += [(400 + i, rows[5][1]) for i in range(150)]                  # a third of all in one place
    rows += [(600, None), (601, []), (602, [0.0] * 12), (603, [-x for x in rows[0][1]])]
    index = DenseIndex.build(_frame(spark, rows), "id", "v", cells=9)
    queries = rows[::17] + [(9000, [0.0] * 12), (9001, None)]
    q = _frame(spark, queries)
    _equal(_rows(index.search(q, "id", "v", k, exclude_self)), _plain(queries, rows, k, exclude_self))


def test_cells_and_slices_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(dense_index, "SLICE_ROWS", 10)
    rows = _clusters(600, 10, 2, spread=0.02)
    index = DenseIndex.build(_frame(spark, rows), "id", "v", cells=20)
    q = _frame(spark, rows[:40])
    read = index.probed(q, "id", "v", 3, True).agg(F.sum("probed_cells"), F.sum("all_cells"), F.sum("probed_slices"), F.sum("all_slices")).first()
    assert read[0] < 0.3 * read[1] and read[2] < 0.3 * read[3]
    assert sum(r["n"] for r in index.cells().collect()) == 600


def test_append_and_reopen(spark):
    rows = _clusters(200, 5, 3) + [(500, [0.0] * 12)]
    index = DenseIndex.build(_frame(spark, rows[:120]), "id", "v")
    index.append(_frame(spark, rows[120:180]), "id", "v")
    DenseIndex(spark, index.path).append(_frame(spark, rows[180:]), "id", "v")
    q = _frame(spark, rows[::9])
    _equal(_rows(DenseIndex(spark, index.path).search(q, "id", "v", 4)), _plain(rows[::9], rows, 4, False))


def test_odd_tables(spark):
    none = _frame(spark, [(1, None), (2, [0.0, 0.0]), (3, [])])
    index = DenseIndex.build(none, "id", "v")
    assert {(r["query_id"], r["context_id"], r["score"]) for r in index.search(none, "id", "v", 1).collect()} == {(i, 1, 0.0) for i in (1, 2, 3)}
    assert DenseIndex.build(none.limit(0), "id", "v").search(none, "id", "v", 2).collect() == []
    one = _frame(spark, [(1, [1.0, 0.0])])
    assert DenseIndex.build(one, "id", "v").search(one, "id", "v", 3, True).collect() == []
    assert len(fit_centroids(_frame(spark, _clusters(50, 3, 4)).withColumnRenamed("v", "value"))) == 7


def test_equals_the_scan(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    want = retrieve_dense(e, e, "vec_id", "embedding", "vec_id", "embedding", 3, True)
    got = DenseIndex.build(e, "vec_id", "embedding").search(e, "vec_id", "embedding", 3, True)
    _equal(_rows(got), _rows(want))


def test_search_makes_no_row_per_query_and_slice(spark, monkeypatch):
    monkeypatch.setattr(dense_index, "SLICE_ROWS", 6)
    rows = _clusters(300, 7, 5, spread=3.0)                              # no clusters: nearly every slice is reached
    index = DenseIndex.build(_frame(spark, rows), "id", "v", cells=9)
    near, made = DenseIndex._near_cells, []

    def counted(self, queries, k, cells):
        out = near(self, queries, k, cells)
        made.append((out.count(), out.columns))
        return out
    monkeypatch.setattr(DenseIndex, "_near_cells", counted)
    q = _frame(spark, rows)
    _equal(_rows(index.search(q, "id", "v", 3, True)), _plain(rows, rows, 3, True))
    assert sum(n for n, _ in made) < 2 * len(rows) and all("value" not in c for _, c in made)
