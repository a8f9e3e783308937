"""Repeated word passages against a plain-Python version."""

import random

from qaspark.llm.substring_dedup import substring_dedup
from tests.conftest import SF_SMALL
from tests.llm import brute


def _rows(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_query_equals_brute_force(spark):
    from qaspark.llm.queries import QUERIES
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    want = brute.repeated_words(docs)
    assert _rows(QUERIES["op3_substring_dedup"](spark, SF_SMALL)) == want
    assert any(n for _, n, _ in want.values())


def test_boundaries_periods_nulls_and_repeated_rows(spark):
    rng = random.Random(8)

    def words(n):
        return [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    hot, edge, long = words(60), words(35), words(34)
    docs = {i: " ".join(words(rng.randrange(0, 50)) + hot[rng.randrange(0, 9):] + words(rng.randrange(0, 50))) for i in range(60)}
    docs[100], docs[101] = " ".join(words(9) + edge), "\n".join(edge + words(9))
    docs[102], docs[103] = " ".join(words(5) + long + words(5)), " ".join(words(7) + long)           # one word too short
    docs[104] = "ab " * 500                                                                          # periodic
    docs[105], docs[106], docs[107] = None, "", " \t "
    docs[108] = " ".join(hot + words(3) + hot)                                                       # repeats itself
    docs[109] = " ".join(words(40_000) + edge)
    docs[110] = " ".join(x + "é\x85 y" for x in words(50))
    docs[111] = docs[110]
    rows = [(d, t, 1, "x") for d, t in docs.items()]
    df = spark.createDataFrame(rows, "k long, body string, runs int, window string").repartition(5)
    want = brute.repeated_words(docs)
    assert _rows(substring_dedup(df, "k", "body")) == want
    odd = spark.createDataFrame([(None, docs[110], 1, "x")], df.schema)
    again = substring_dedup(df.unionAll(df).unionAll(odd), "k", "body")
    assert again.count() == 2 * len(docs) + 1
    got = _rows(again)
    assert got.pop(None)[1] == 0 and got == want
    assert substring_dedup(df.limit(0), "k", "body").collect() == []


def test_one_id_with_several_texts(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n)) for n in (10, 40, 90, 200)]
    rows = [(1, texts[0]), (1, texts[1] + " " + passage), (2, passage + " " + texts[2]), (2, texts[3]), (2, texts[3]), (None, passage), (3, None), (3, "")]
    got = sorted(tuple(r) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).na.fill(-1, ["doc_id"]).collect())
    apart = list(dict.fromkeys(r for r in rows if r[0] is not None))
    want = brute.repeated_words(dict(enumerate(t for _, t in apart)))
    expected = [(r[0], *want[apart.index(r)]) for r in rows if r[0] is not None] + [(-1, 50, 0, brute.sha(passage))]
    assert got == sorted(expected)
