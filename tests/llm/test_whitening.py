"""Whitening: the eigenvectors against a dense solver, the query against plain arithmetic."""

import math

import numpy as np
import pytest

from qaspark.llm.queries import QUERIES
from qaspark.llm.whitening import leading_components, leading_values, sturm_counts, tridiagonal, whiten
from tests.conftest import SF_SMALL


def _matrices():
    rng = np.random.default_rng(5)
    yield "random", np.cov(rng.normal(size=(20, 300)))
    yield "low rank", np.cov(rng.normal(size=(12, 4)) @ rng.normal(size=(4, 200)))
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    yield "wide range", (q * 10.0 ** -np.arange(30.0).clip(max=10)) @ q.T
    yield "clusters", (q * np.repeat([5.0, 5.0 + 1e-9, 1.0], 10)) @ q.T
    yield "diagonal", np.diag(np.arange(1.0, 9.0))
    yield "equal", np.eye(7) * 3.0
    yield "blocks", np.kron(np.eye(4), np.array([[2.0, 1.0], [1.0, 2.0]]))
    yield "one", np.array([[4.0]])
    yield "two", np.array([[2.0, -1.0], [-1.0, 2.0]])


@pytest.mark.parametrize("name,a", list(_matrices()), ids=[n for n, _ in _matrices()])
def test_eigenvectors(name, a):
    values, vectors = leading_components(a, 32)
    want = np.linalg.eigvalsh((a + a.T) / 2)[::-1]
    k = len(values)
    assert k == int((want > 1e-13 * want[0]).sum())
    assert np.allclose(values, want[:k], rtol=0, atol=1e-13 * want[0])
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * want[0]


def test_steps():
    a = np.cov(np.random.default_rng(1).normal(size=(15, 40)))
    diag, off, mirrors = tridiagonal(a)
    t = np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)
    want = np.linalg.eigvalsh(a)
    assert np.allclose(np.linalg.eigvalsh(t), want, atol=1e-13) and len(mirrors) == 13
    points = np.array([-1.0, want[4] + 1e-6, want[-1] + 1.0])
    assert sturm_counts(diag, off, points).tolist() == [0, 5, 15]
    assert np.allclose(leading_values(diag, off, 3), want[::-1][:3], atol=1e-14)
    assert leading_components(np.zeros((3, 3)))[0].size == 0


def _check(rows, vectors, k):
    """``rows`` of the operator against integer arithmetic and a dense solver."""
    x = {i: [math.floor(64 * float(c)) + 1000000 for c in v] for i, v in vectors.items()}
    n, d = len(x), len(next(iter(x.values())))
    s = [sum(v[j] for v in x.values()) for j in range(d)]
    dev = {i: [n * v[j] - s[j] for j in range(d)] for i, v in x.items()}
    z = np.array([dev[i] for i in sorted(x)], float) / n
    cov = z.T @ z / n
    want, basis = np.linalg.eigh(cov)
    want, basis = want[::-1][:k], basis[:, ::-1][:, :k]
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(got) == n * k
    for p in range(k):
        col = np.array([got[i, p + 1]["whitened"] for i in sorted(x)])
        plain = z @ basis[:, p] / math.sqrt(want[p])
        assert min(np.abs(col - plain).max(), np.abs(col + plain).max()) < 1e-8
    for (i, p), r in got.items():
        assert r["n"] == n and r["deviation"] == sum(e * e for e in dev[i])
        assert abs(r["explained"] - want[p - 1] / np.trace(cov)) < 1e-10
        assert r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in rows}) == 1


def test_query(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: r["embedding"] for r in rows
               if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])}
    _check(QUERIES["op12_embedding_whitening"](spark, SF_SMALL).collect(), vectors, 32)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = {i: rng.normal(size=3).tolist() for i in range(40)}
    good[40] = good[0]
    odd = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 2.0]), (53, [float("inf"), 1.0, 2.0]), (54, []), (55, [1.0, 2.0])]
    rows = [(i, v, "x", 1) for i, v in [*good.items(), *odd]]
    df = spark.createDataFrame(rows, "id long, v array<double>, whitened string, n int").repartition(5)
    _check(whiten(df, "id", "v").collect(), good, 3)
    again = whiten(df.unionAll(df), "id", "v").collect()                     # repeated rows
    assert len(again) == 2 * 3 * 41 and {r["n"] for r in again} == {82}
    null_ids = whiten(df.selectExpr("cast(null as long) as id", "v"), "id", "v").collect()
    assert len(null_ids) == 3 * 41 and {r["vec_id"] for r in null_ids} == {None}
    assert whiten(df.limit(0), "id", "v").collect() == []
    assert whiten(df.filter("id >= 50 AND id < 55"), "id", "v").collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "id long, v array<double>")
    assert whiten(same, "id", "v").collect() == []


def test_large_numbers(spark):
    rows = [(i, [1e17 * i, float(i % 3)]) for i in range(6)] + [(9, [1e300, 0.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 7 * len({r["component"] for r in got})
    assert all(r["deviation"] is None or r["deviation"] > 0 for r in got)
