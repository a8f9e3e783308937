"""The lexical index on disk against the scan and plain Python."""

import random

import pytest

from qaspark.operators import lexical_index
from qaspark.operators.lexical_index import LexicalIndex
from qaspark.operators.retrieve import build_postings, index_size, retrieve_lexical
from tests.conftest import SF_SMALL


def _corpus(n, seed):
    """Texts over few frequent and many rare words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [(i * 7 % 5000 - 900, " ".join(rng.choices(words, weights, k=rng.randint(3, 30)))) for i in range(n)]


def _plain(queries, corpus, k):
    texts = {}
    for i, t in corpus:
        texts.setdefault(i, set()).update((t or "").split())
    out = {}
    for q, t in queries:
        toks = set((t or "").split())
        score = sorted((-(len(toks & d) / len(toks) if toks else 0.0), i) for i, d in texts.items())
        for r, (s, i) in enumerate(score[:k], 1):
            out[q, r] = (i, -s)
    return out


def _rows(df):
    rows = df.collect()
    out = {(r["query_id"], r["rank"]): (r["context_id"], r["score"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("k,left_out", [(1, 0.5), (3, 0.5), (5, 0.9), (3, 0.0)])
def test_search_equals_scan(spark, monkeypatch, k, left_out):
    monkeypatch.setattr(lexical_index, "LEFT_OUT", left_out)
    monkeypatch.setattr(lexical_index, "LONG_LIST", 5)
    monkeypatch.setattr(lexical_index, "BLOCK_BITS", 4)
    corpus = _corpus(500, 1) + [(6000, None), (6001, "")]
    rng = random.Random(9)
    queries = [(i, " ".join(t.split()[::2])) for i, (_, t) in enumerate(corpus[:60])]
    queries += [(100, "w0 w1 w2 w3"), (101, "unknown words"), (102, ""), (103, None), (104, " ".join(f"w{rng.randrange(400)}" for _ in range(20)))]
    index = LexicalIndex.build(spark.createDataFrame(corpus, "id long, t string"), "id", "t")
    q = spark.createDataFrame(queries, "qid long, text string")
    assert _rows(index.search(q, "qid", "text", k)) == _plain(queries, corpus, k)
    read = index.lists_read(q, "qid", "text", k).collect()
    assert all(0 <= r["skipped"] <= r["left_out"] < r["tokens"] for r in read)
    if left_out == 0.5:                                          # some lists wait and are read, some never are
        assert any(0 < r["skipped"] for r in read) and any(r["skipped"] < r["left_out"] for r in read)


def test_append_in_parts(spark):
    corpus = _corpus(300, 2)
    frames = [spark.createDataFrame(corpus[a:a + 100], "id long, t string") for a in (0, 100, 200)]
    index = LexicalIndex.build(frames[0], "id", "t")
    index.append(frames[1], "id", "t")
    LexicalIndex(spark, index.path).append(frames[2], "id", "t")
    index.append(spark.createDataFrame([(corpus[0][0], "w399 extra")], "id long, t string"), "id", "t")     # an id again
    queries = [(i, t) for i, (_, t) in enumerate(corpus[::11])] + [(99, "w399 extra w5")]
    q = spark.createDataFrame(queries, "qid long, text string")
    assert _rows(index.search(q, "qid", "text", 3)) == _plain(queries, [*corpus, (corpus[0][0], "w399 extra")], 3)


def test_kept_index_is_not_rebuilt(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "corpus")
    spark.createDataFrame(_corpus(50, 3), "id long, t string").write.parquet(path)
    first = LexicalIndex.open_or_build(spark.read.parquet(path), "id", "t")
    writes = []
    plain = LexicalIndex._write
    monkeypatch.setattr(LexicalIndex, "_write", lambda self, *a: (writes.append(1), plain(self, *a)))
    assert LexicalIndex.open_or_build(spark.read.parquet(path), "id", "t").path == first.path and not writes
    spark.createDataFrame(_corpus(5, 4), "id long, t string").write.mode("append").parquet(path)
    again = LexicalIndex.open_or_build(spark.read.parquet(path), "id", "t")
    assert again.path != first.path and len(writes) == 1                       # a changed source is noticed


def test_size_and_empty(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    index = LexicalIndex.open_or_build(docs, "doc_id", "text")
    assert index.size().first() == index_size(build_postings(docs, "doc_id", "text")).first()
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    assert _rows(index.search(bench, "item_id", "text", 3)) == _rows(retrieve_lexical(bench, docs, "item_id", "text", "doc_id", "text", k=3))
    nothing = LexicalIndex.build(docs.limit(0), "doc_id", "text")
    assert nothing.search(bench, "item_id", "text").collect() == []
    assert index.search(bench.limit(0), "item_id", "text").collect() == []


def test_postings_are_made_where_their_block_lies(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(lexical_index, "BLOCK_BITS", 4)
    monkeypatch.setattr(lexical_index, "HELD", 20)                       # repeated postings are dropped in between
    corpus = _corpus(200, 5) + [(None, "w1 w2")] + _corpus(200, 5) * 2 + [(7, "w1 other")]
    index = LexicalIndex.build(spark.createDataFrame(corpus, "id long, t string").repartition(6), "id", "t")
    p = index.postings()
    files = p.withColumn("f", F.input_file_name()).groupBy("block").agg(F.count_distinct("f").alias("files")).collect()
    assert len(files) > 10 and {r["files"] for r in files} == {1}
    want = {(t, i) for i, text in corpus if i is not None for t in text.split()}
    got = [(r["token"], r["block"], r["n"], r["ids"]) for r in p.collect()]
    assert sorted((t, i) for t, _, _, ids in got for i in ids) == sorted(want)
    assert all(ids == sorted(ids) and n == len(ids) and {i >> 4 for i in ids} == {b} for _, b, n, ids in got)
    assert len({(t, b) for t, b, _, _ in got}) == len(got)


def test_postings_are_not_shuffled_for_few_words(spark):
    index = LexicalIndex.build(spark.createDataFrame(_corpus(100, 6), "id long, t string"), "id", "t")
    words = spark.createDataFrame([(1, "w0"), (1, "w5"), (2, "w0")], "query_id long, token string")
    for df in (index._counted(words), index._lists(words, "n")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
