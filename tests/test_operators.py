"""Scale operators against brute force on small fixtures with hot keys."""

import itertools
import random
import re

import numpy as np
import pytest

from qaspark.operators import sequence as seq
from qaspark.operators.recall_join import recall_join
from qaspark.operators.retrieve import retrieve_dense, retrieve_lexical

WORD = re.compile(r"\w+")


def _tok(t):
    return set(WORD.findall(t.lower()))


def _corpus(n, seed, hot="the"):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        k = rnd.randint(0, 12)
        ws = [rnd.choice(vocab) for _ in range(k)]
        if rnd.random() < 0.8:
            ws.append(hot)          # a token present in most texts
        out.append((i, " ".join(ws)))
    return out


@pytest.mark.parametrize("threshold,rps", [(0.5, 1_000_000), (0.8, 10), (1.0, 3)])
def test_recall_join_matches_brute_force(spark, threshold, rps):
    """Exact against brute force, without salting and with hot tokens salted
    over many buckets."""
    truths = _corpus(25, 1) + [(100, "the"), (101, "the w1"), (102, "!!!")]
    texts = _corpus(300, 2)
    tdf = spark.createDataFrame(truths, "tid long, text string")
    ddf = spark.createDataFrame(texts, "did long, text string")
    got = {(r.tid, r.did): r.token_recall for r in
           recall_join(tdf, ddf, "tid", "text", "did", "text", threshold, rows_per_salt=rps).collect()}
    want = {}
    for (tid, tt), (did, dt) in itertools.product(truths, texts):
        t = _tok(tt)
        if t and len(t & _tok(dt)) / len(t) >= threshold:
            want[(tid, did)] = len(t & _tok(dt)) / len(t)
    assert got == want


def test_running_stats_hot_run(spark):
    rnd = random.Random(3)
    rows = [(0 if rnd.random() < 0.6 else rnd.randint(1, 5), i, rnd.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "run long, o long, v double")
    got = {(r.run, r.o): (r.position, r.run_count, r.running_mean) for r in
           seq.running_mean(df, ["run"], ["o"], "v", n_blocks=8).collect()}
    by_run = {}
    for run, o, v in sorted(rows, key=lambda x: (x[0], x[1])):
        by_run.setdefault(run, []).append((o, v))
    for run, lst in by_run.items():
        s = 0.0
        for pos, (o, v) in enumerate(lst, 1):
            s += v
            p, n, m = got[(run, o)]
            assert (p, n) == (pos, len(lst)) and m == pytest.approx(s / pos)


def test_first_n(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(50)], "g long, o long")
    rows = seq.first_n(df, ["g"], ["o"], 5).collect()
    assert len(rows) == 15 and all(r.position <= 5 for r in rows)
    assert {(r.g, r.n_more) for r in rows} == {(0, 12), (1, 12), (2, 11)}


def test_dense_top_k(spark):
    rnd = np.random.default_rng(5)
    vecs = rnd.normal(size=(120, 8)).astype(np.float32)
    vecs[7] = 0.0                                     # zero vector scores 0
    vecs[9] = vecs[10]                                # exact tie
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, e array<float>")
    got = sorted((r.query_id, r.rank, r.context_id) for r in
                 retrieve_dense(df, df, "id", "e", "id", "e", k=3, exclude_self=True).collect())
    v = vecs.astype(np.float64)
    n = np.linalg.norm(v, axis=1)
    want = []
    for q in range(len(v)):
        sc = [((v[q] @ v[c]) / (n[q] * n[c]) if n[q] > 0 and n[c] > 0 else 0.0, c) for c in range(len(v)) if c != q]
        sc.sort(key=lambda x: (-round(x[0], 12), x[1]))
        want += [(q, i + 1, c) for i, (_, c) in enumerate(sc[:3])]
    assert got == sorted(want)


def test_lexical_top_k(spark):
    queries = _corpus(30, 7) + [(500, "")]
    corpus = _corpus(200, 8)
    q = spark.createDataFrame(queries, "qid long, text string")
    c = spark.createDataFrame(corpus, "cid long, text string")
    got = sorted((r.query_id, r.rank, r.context_id, r.score) for r in
                 retrieve_lexical(q, c, "qid", "text", "cid", "text", k=3).collect())
    want = []
    for qid, qt in queries:
        t = _tok(qt)
        sc = sorted(((len(t & _tok(ct)) / len(t) if t else 0.0), cid) for cid, ct in corpus)
        sc.sort(key=lambda x: (-x[0], x[1]))
        want += [(qid, i + 1, cid, s) for i, (s, cid) in enumerate(sc[:3])]
    assert got == sorted(want)


def test_running_stats_many_blocks(spark):
    rnd = random.Random(4)
    rows = [(0 if rnd.random() < 0.7 else rnd.randint(1, 3), i, float(rnd.randint(0, 9))) for i in range(3000)]
    df = spark.createDataFrame(rows, "run long, o long, v double")
    got = {(r.run, r.o): (r.position, r.run_count, r.running_sum_v) for r in
           seq.running_stats(df, ["run"], ["o"], ["v"], n_blocks=400).collect()}
    acc = {}
    for run, o, v in sorted(rows, key=lambda x: (x[0], x[1])):
        cnt, tot = acc.get(run, (0, 0.0))
        acc[run] = (cnt + 1, tot + v)
        assert got[(run, o)][0] == cnt + 1 and got[(run, o)][2] == tot + v
    assert all(got[(run, o)][1] == acc[run][0] for run, o, _ in rows)


def test_recall_join_checkpointed_postings(spark):
    truths = _corpus(20, 5) + [(100, "the w2")]
    texts = _corpus(200, 6)
    tdf = spark.createDataFrame(truths, "tid long, text string")
    ddf = spark.createDataFrame(texts, "did long, text string")
    got = {(r.tid, r.did) for r in recall_join(tdf, ddf, "tid", "text", "did", "text", 0.7, rows_per_salt=5,
                                               materialize_postings=True).collect()}
    want = {(tid, did) for (tid, tt), (did, dt) in itertools.product(truths, texts)
            if _tok(tt) and len(_tok(tt) & _tok(dt)) / len(_tok(tt)) >= 0.7}
    assert got == want


@pytest.mark.parametrize("n_blocks", [1, 3, 40])
def test_running_stats_null_runs_and_values(spark, n_blocks):
    """Any number of blocks gives the same rows: a null run is a run, null values
    add nothing, and a sum is null until the run's first value."""
    rnd = random.Random(12)
    rows = [(None if rnd.random() < 0.3 else rnd.randint(0, 2), i, None if rnd.random() < 0.4 or i < 60 else rnd.randint(0, 9))
            for i in range(300)]
    df = spark.createDataFrame(rows, "run long, o long, v long")
    got = {r.o: (r.run, r.position, r.run_count, r.running_sum_v)
           for r in seq.running_stats(df, ["run"], ["o"], ["v"], n_blocks=n_blocks).collect()}
    count, total, want = {}, {}, {}
    for run, o, v in rows:
        count[run] = count.get(run, 0) + 1
        if v is not None:
            total[run] = total.get(run, 0) + v
        want[o] = [run, count[run], None, total.get(run)]
    for w in want.values():
        w[2] = count[w[0]]
    assert got == {o: tuple(w) for o, w in want.items()}
    head = seq.first_n(df, ["run"], ["o"], 4).collect()
    assert len(head) == 4 * len(count) and {(r.run, r.run_count) for r in head} == set(count.items())


def test_dense_null_vectors_score_zero(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "id long, e array<float>")
    got = {(r.query_id, r.rank): (r.context_id, r.score) for r in
           retrieve_dense(df, df, "id", "e", "id", "e", k=3, exclude_self=True).collect()}
    assert got[(0, 1)][0] == 1 and got[(0, 2)] == (2, 0.0) and got[(0, 3)] == (3, 0.0)
    assert got[(2, 1)] == (0, 0.0)                     # a zero query scores 0 everywhere (ties by id)


def test_skew_join_matches_plain_join(spark):
    from qaspark.operators.skew import hot_keys, skew_join
    rnd = random.Random(11)
    big = spark.createDataFrame([(0 if rnd.random() < 0.4 else rnd.randint(1, 30), i, rnd.random())
                                 for i in range(3000)], "k long, i long, v double")
    small = spark.createDataFrame([(k, f"s{k}", j) for k in range(0, 25) for j in range(2)], "k long, s string, j int")
    hot = {r.k: r.buckets for r in hot_keys(big, ["k"], rows_per_bucket=100, sample_of=1).collect()}
    assert hot.get(0, 1) > 5                                        # the hot key is split
    for how in ("inner", "left"):
        got = sorted(tuple(r) for r in skew_join(big, small, ["k"], how, rows_per_bucket=100, sample_of=2)
                     .select("k", "i", "s", "j").collect())
        want = sorted(tuple(r) for r in big.join(small, ["k"], how).select("k", "i", "s", "j").collect())
        assert got == want


def test_recall_join_without_truth_broadcast(spark, monkeypatch):
    """Truth tokens above the broadcast bound: the candidate expansion goes
    through the salted skew join and the result stays exact."""
    from qaspark.operators import recall_join as rj
    monkeypatch.setattr(rj, "BROADCAST_MAX_ROWS", 5)
    truths = _corpus(15, 21) + [(100, "the w3")]
    texts = _corpus(150, 22)
    tdf = spark.createDataFrame(truths, "tid long, text string")
    ddf = spark.createDataFrame(texts, "did long, text string")
    got = {(r.tid, r.did) for r in rj.recall_join(tdf, ddf, "tid", "text", "did", "text", 0.6).collect()}
    want = {(tid, did) for (tid, tt), (did, dt) in itertools.product(truths, texts)
            if _tok(tt) and len(_tok(tt) & _tok(dt)) / len(_tok(tt)) >= 0.6}
    assert got == want


def test_skew_join_spreads_null_keys(spark):
    from qaspark.operators.skew import skew_join
    big = spark.createDataFrame([(None if i % 2 else i % 7, i) for i in range(400)], "k long, i long")
    small = spark.createDataFrame([(k, f"s{k}") for k in (0, 2, None)], "k long, s string")
    got = sorted(tuple(r) for r in skew_join(big, small, ["k"], "left", 10, 1).select("i", "s").collect())
    assert got == sorted(tuple(r) for r in big.join(small, ["k"], "left").select("i", "s").collect())


@pytest.mark.parametrize("k", [3, 40])
def test_tiles_of_any_size_give_the_same_top_k(spark, monkeypatch, k):
    """Small tiles, repeated query ids, null texts and vectors: still the brute-force result."""
    from qaspark.operators import retrieve
    monkeypatch.setattr(retrieve, "TILE_ROWS", 7)
    queries = _corpus(20, 51) + [(500, None), (501, ""), (501, "")]
    corpus = _corpus(60, 52) + [(900, None)]
    q = spark.createDataFrame(queries, "qid long, text string").repartition(3)
    c = spark.createDataFrame(corpus, "cid long, text string").repartition(5)
    got = {}
    for r in retrieve_lexical(q, c, "qid", "text", "cid", "text", k=k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.context_id, r.score))
    index = {}
    postings = retrieve.build_postings(c, "cid", "text")
    for r in retrieve.retrieve_from_index(q.dropDuplicates(["qid"]), postings, c, "qid", "text", "cid", k=k).collect():
        index.setdefault(r.query_id, []).append((r["rank"], r.context_id, r.score))
    for qid, qt in queries:
        t = _tok(qt or "")
        sc = sorted(((len(t & _tok(ct or "")) / len(t) if t else 0.0), cid) for cid, ct in corpus)
        sc.sort(key=lambda x: (-x[0], x[1]))
        want = [(i + 1, cid, s) for i, (s, cid) in enumerate(sc[:k])]
        if qid != 501:
            assert sorted(got[qid]) == want
        assert sorted(index[qid]) == want
    assert len(got[501]) == k                                          # a repeated id ends, with k rows


def test_retrieval_runs_outside_the_repository(tmp_path):
    """A session started in an unrelated folder: the workers import the shipped package."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {repo!r})\n"
            "import __spark_entry__ as E\nfrom qaspark.session import build_session\n"
            "s = build_session('local[2]', 2)\n"
            "for q in ('q20_retrieve_dense', 'q21_retrieve_lexical', 'q35_context_prompts', 'q37_evaluation'):\n"
            "    print(q, E.queries()[q](s, '/root/testdata/sf0.001').count() if q in E.queries() else 1)\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]


def test_lexical_expansion_in_slices(spark, monkeypatch):
    """Tiny expansion slices (a common token shared by every query) give the
    same top-k as one big expansion."""
    from qaspark.operators import retrieve
    queries = [(i, f"the w{i % 7} w{i % 5}") for i in range(40)]
    corpus = _corpus(120, 31)
    q = spark.createDataFrame(queries, "qid long, text string")
    c = spark.createDataFrame(corpus, "cid long, text string")
    want = sorted(tuple(r) for r in retrieve_lexical(q, c, "qid", "text", "cid", "text", k=3).collect())
    monkeypatch.setattr(retrieve, "MAX_EXPANSION", 7)
    got = sorted(tuple(r) for r in retrieve_lexical(q, c, "qid", "text", "cid", "text", k=3).collect())
    assert got == want


def test_assign_blocks_contiguous(spark):
    rnd = random.Random(8)
    rows = [(rnd.randint(0, 2), i) for i in range(500)]
    df = spark.createDataFrame(rows, "run long, o long")
    got = sorted((r["run"], r["o"], r["__block"]) for r in seq.assign_blocks(df, ["run"], ["o"], n_blocks=10).collect())
    blocks = [b for _, _, b in got]
    assert blocks == sorted(blocks) and len(set(blocks)) > 5      # non-decreasing along (run, o): contiguous


@pytest.mark.parametrize("freq", [0, 3])
def test_lexical_dense_path_matches_brute_force(spark, monkeypatch, freq):
    """Shared tokens scored by the dense product (all of them, or those in
    more than 3 queries) give the brute-force top-k."""
    from qaspark.operators import retrieve
    monkeypatch.setattr(retrieve, "FREQ_QUERIES", freq)
    queries = _corpus(30, 41) + [(500, "")]
    corpus = _corpus(150, 42)
    q = spark.createDataFrame(queries, "qid long, text string")
    c = spark.createDataFrame(corpus, "cid long, text string")
    got = sorted((r.query_id, r.rank, r.context_id, r.score) for r in
                 retrieve_lexical(q, c, "qid", "text", "cid", "text", k=3).collect())
    want = []
    for qid, qt in queries:
        t = _tok(qt)
        sc = sorted(((len(t & _tok(ct)) / len(t) if t else 0.0), cid) for cid, ct in corpus)
        sc.sort(key=lambda x: (-x[0], x[1]))
        want += [(qid, i + 1, cid, s) for i, (s, cid) in enumerate(sc[:3])]
    assert got == sorted(want)


@pytest.mark.parametrize("k,exclude_self", [(3, True), (1, False), (20, False)])
def test_dense_grid_equals_brute_force(spark, monkeypatch, k, exclude_self):
    import numpy as np
    from qaspark.operators import retrieve
    for name, value in (("TILE_ROWS", 40), ("SEED_ROWS", 7), ("SCORES", 500), ("COLUMN_BYTES", 4000)):
        monkeypatch.setattr(retrieve, name, value)
    v = np.random.default_rng(3).normal(size=(260, 5)).astype("float32")
    v[200:] = v[:60]                                                     # equal vectors tie
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>").repartition(3)
    got = {(r["query_id"], r["rank"]): r["context_id"] for r in
           retrieve.retrieve_dense(e, e, "id", "v", "id", "v", k, exclude_self).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    want = {}
    for q, s in enumerate(np.round(u @ u.T, 10)):
        order = sorted((-x, i) for i, x in enumerate(s.tolist()) if not (exclude_self and i == q))
        want |= {(q, r): i for r, (_, i) in enumerate(order[:k], 1)}
    assert got == want


def test_dense_tiles_are_copied_to_few_partitions():
    from qaspark.operators.retrieve import COLUMN_BYTES, _grid
    rows, columns = _grid(200, 600_000, 600_000, 64)
    assert 200 <= rows * columns <= 300 and rows + columns < 40          # copies of a corpus and a query tile
    assert _grid(200, 200, 600_000, 64)[0] == 1                          # few queries: the corpus is not copied
    assert 10 ** 9 * 64 * 8 / _grid(200, 10 ** 6, 10 ** 9, 64)[1] <= COLUMN_BYTES
