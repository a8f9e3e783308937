"""Near duplicates and components against all-pairs versions."""

import random

import numpy as np
import pytest

from qaspark.llm import near_dedup as N
from qaspark.llm.components import connected_components
from tests.conftest import SF_SMALL
from tests.llm import brute


def _rows(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_equals_all_pairs(spark):
    from qaspark.llm.queries import QUERIES
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = QUERIES["op4_near_dedup"](spark, SF_SMALL)
    assert _rows(got) == brute.near_components(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


@pytest.mark.parametrize("small,tile", [(N.SMALL_BUCKET, N.TILE_ROWS), (0, N.TILE_ROWS), (1, 5)])
def test_chains_ties_nulls_and_clashing_columns(spark, monkeypatch, small, tile):
    monkeypatch.setattr(N, "TILE_ROWS", tile)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(4000)]
    docs, i = {}, 0
    for base in range(6):                                   # drifting copies: neighbours are alike, far ones are not
        words = [rng.choice(vocab) for _ in range(120)]
        for _ in range(9):
            docs[i] = " ".join(words)
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocab)
            i += 1
    for t in (None, "", " \t\n", "one two", "ONE two", "one  Two", "É a b c", "é a b c", "a b c d a b c d a b c d", "a b c d a b c d"):
        docs[i] = t
        i += 1
    rows = [(d, t, "x", 1) for d, t in docs.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, body string, band string, component long")
    want = brute.near_components(docs)
    got = N.near_duplicates(df, "k", "body", size=4, small_bucket=small)
    assert _rows(got) == want
    assert len({c for _, c in want.values()}) < len(docs) - 40
    doubled = N.near_duplicates(df.unionAll(df).unionAll(spark.createDataFrame([(None, "one two", "", 0)], df.schema)), "k", "body", size=4)
    rows = doubled.collect()
    assert len(rows) == 2 * len(docs) + 1
    assert {(r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None} == {(d, c) for d, (_, c) in want.items()}
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    assert N.near_duplicates(df.limit(0), "k", "body").collect() == []


def test_loose_group_in_one_bucket(spark):
    """Many edits of one text: most pairs are no links, and the few that are must be found."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    docs = {}
    for i in range(90):
        words = list(base)
        for p in rng.sample(range(150), rng.randrange(0, 9)):
            words[p] = f"x{rng.randrange(10 ** 6)}"
        docs[i] = " ".join(words)
    want = brute.near_components(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for small in (0, 1000):
        assert _rows(N.near_duplicates(df, size=4, small_bucket=small)) == want
    assert 1 < len({c for _, c in want.values()}) < 80


def test_signature_estimates_with_little_variance():
    rng = np.random.default_rng(2)
    shares = []
    for _ in range(60):
        x = rng.integers(0, 2 ** 63, 900).astype(np.uint64)
        sig = N.super_minhash([x[:500], np.concatenate([x[55:500], x[500:555]])])
        shares.append((sig[0] == sig[1]).mean())
    true = 445 / 555
    assert abs(np.mean(shares) - true) < 0.01 and np.std(shares) < (true * (1 - true) / N.PLACES) ** 0.5
    short = [rng.integers(0, 2 ** 63, n).astype(np.uint64) for n in (1, 2, 5, 300)]
    together, alone = N.super_minhash(short), np.concatenate([N.super_minhash([s]) for s in short])
    assert np.isfinite(together).all() and (together == alone).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    edges += [(500, 500), (600, 601), (601, 600), (600, 601)] + [(900, 1000 + i) for i in range(200)] + [(None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_one_id_with_several_texts(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(5, body), (5, "one two three four five"), (6, body + " end"), (7, "one two three four five"), (7, None), (None, body), (5, body)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in got)
    assert seen == sorted([(5, 56, 5, True), (5, 56, 5, True), (5, 1, 5, True), (6, 57, 5, False), (7, 1, 5, False), (7, 0, 7, True),
                           (-1, 56, -1, True)])
    alike = N.near_duplicates(spark.createDataFrame([(5, body), (5, body + " end")], "doc_id long, text string")).collect()
    assert sorted(r["kept"] for r in alike) == [False, True] and {r["component_id"] for r in alike} == {5}
