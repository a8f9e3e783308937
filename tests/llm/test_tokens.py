"""Token ids against the library, counts through the cache, and the packing round trip."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from qaspark.llm import packing as P
from qaspark.llm.queries import QUERIES
from qaspark.llm.token_counts import CountCache, token_counts, tokenizer_version
from qaspark.llm.tokens import TextEncoder, vocabulary_path
from tests.conftest import SF_SMALL

HARD = ["", " ", "a  b", " a b ", "a <|endoftext|> b c<|endoftext|>d", "x\x1c y \x85 z\xa0 w", "don't I'LL we've 'tis", "a\n\n b\tc \r\n",
        "".join(map(chr, range(0x250))), " ".join(map(chr, range(0x300))), "日本 語 😀😀 x y", "1234 5,678.90 ²½", "word " * 3000]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(vocabulary_path())


def test_encoder_equals_library(spark, tok):
    enc = TextEncoder(vocabulary_path())
    docs = [r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    for t in HARD + docs:
        assert enc.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids, t[:80]


@pytest.mark.parametrize("mark", [" ", "\n", "\t", "\xa0", "a", "é", "7", "."])
def test_two_million_of_one_character(tok, mark):
    enc = TextEncoder(vocabulary_path())
    for text in (mark * 2_000_000, "x y" + mark * 2_000_000 + "z"):
        assert enc.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_queries_take_very_long_texts(spark, tok):
    docs = {1: " " * 1_100_000, 2: "a b" + "\n" * 1_100_000 + "c", 3: "q" * 1_000_000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = {d: len(tok.encode(t, add_special_tokens=False).ids) for d, t in docs.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()} == want
    packed = P.pack_documents(df).groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"]: r["sum(length)"] for r in packed} == {d: n + 1 for d, n in want.items()}


def test_count_query(spark, tok):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op9_token_counts"](spark, SF_SMALL).collect()}
    n = {d: len(tok.encode(t, add_special_tokens=False).ids) for d, t in docs.items()}
    assert got == {d: (len(t.encode()), n[d], n[d] > 512) for d, t in docs.items()}


def test_cache_encodes_only_misses(spark, tok):
    version = tokenizer_version(vocabulary_path())
    cache = CountCache(spark)
    rows = [(1, "a b c", 7), (1, "a b c", 7), (None, "a b c", 7), (2, None, 7), (3, "", 7)] + [(10 + i, t, 7) for i, t in enumerate(HARD)]
    df = spark.createDataFrame(rows, "id long, body string, n_tokens int")
    want = sorted((d or 0, len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows)
    got = token_counts(df, "id", "body", cache=cache)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got.collect()) == want
    assert cache.read(version).count() == len({t or "" for _, t, _ in rows})
    token_counts(df.unionAll(spark.createDataFrame([(99, "new text", 7)], df.schema)), "id", "body", cache=cache)
    assert cache.read(version).count() == len({t or "" for _, t, _ in rows}) + 1
    assert cache.read("another version").count() == 0
    assert token_counts(df.limit(0), "id", "body").collect() == []


def _check_packing(rows, docs, tok, capacity):
    want = Counter()
    for d, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        at = 0
        first = len(ids) % capacity or capacity
        sizes = [first] + [capacity] * ((len(ids) - first) // capacity)
        for i, n in enumerate(sizes):
            want[d, i, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())] += 1
            at += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity
    return len(bins), sum(r["length"] for r in rows)


def test_packing_query(spark, tok):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    n, total = _check_packing(QUERIES["op2_pattern_packing"](spark, SF_SMALL).collect(), docs, tok, 2048)
    assert n <= 1.02 * -(-total // 2048) + 1


def test_packing_small_parts_nulls_and_ties(spark, tok, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_PART", 3)
    rows = [(i, "word " * (i % 23), 1, 2) for i in range(120)] + [(7, "same", 1, 2)] * 9 + [(None, "no id", 1, 2), (500, None, 1, 2), (501, "a " * 900, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int, part int")
    _check_packing(P.pack_documents(df, capacity=64).collect(), [(r[0], r[1]) for r in rows], tok, 64)
    assert P.pack_documents(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_each_piece_once_and_packs_well(seed):
    rng = np.random.default_rng(seed)
    capacity = 256
    lengths = {0: rng.integers(1, 257, 5000), 1: np.full(1000, 100), 2: rng.integers(1, 20, 900), 3: np.array([256, 255, 1]),
               4: np.minimum(256, rng.geometric(0.02, 4000)), 5: rng.choice([128, 129, 127, 86, 85], 3000)}[seed]
    hist = np.bincount(lengths, minlength=capacity + 1)
    plan = P.plan_patterns(hist, capacity)
    used = Counter()
    for pattern, r in plan:
        assert sum(pattern) <= capacity and r > 0
        for n in pattern:
            used[n] += r
    assert used == Counter(lengths.tolist())
    sequences = sum(r for _, r in plan)
    # first fit decreasing, piece by piece
    bins = []
    for n in sorted(lengths.tolist(), reverse=True):
        for i, space in enumerate(bins):
            if space >= n:
                bins[i] -= n
                break
        else:
            bins.append(capacity - n)
    assert sequences <= 1.01 * len(bins) + 1
    assert P.plan_patterns(np.zeros(capacity + 1, int), capacity) == []
