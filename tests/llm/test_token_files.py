"""Token files: the coder's round trip, ids against the library, the query against plain Python."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from qaspark.llm.ans import CHECK_STEPS, Model, decode, encode, lanes_for, quantised
from qaspark.llm.queries import QUERIES
from qaspark.llm.token_files import TokenFiles, crc32_before, token_file_report, write_token_files
from qaspark.llm.tokens import vocabulary_path
from qaspark.llm.word_tokens import WordEncoder
from tests.conftest import SF_SMALL

HARD = ["", " ", "a  b", "don't I'LL we've 'tis '' 's'S", "a <|endoftext|> b<|startoftext|>c", "İstanbul x", "x\x1c y \x85 z\xa0 w​", "²½ ª ß ŉ ſ",
        "".join(map(chr, range(0x180))), " ".join(map(chr, range(0x300))), "日本 語 😀😀 x y", "é Å Å", "Σίσυφος ΣΑΣ", "1234 5,678.90",
        "word " * 3000, "a" * 5000, "!" * 5000, "é" * 300 + "." * 300, "a\0b", "\0", "x" + " " * 5000 + "y"]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


def test_encoder_equals_library(spark, tok):
    enc = WordEncoder(vocabulary_path("word_bpe_49k.json"))
    docs = [r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    texts = HARD + docs + [chr(c) + "a " + chr(c) * 2 for c in range(0x200)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [enc.encode(t).tolist() for t in texts] == want


@given(st.integers(0, 5000), st.integers(1, 700), st.integers(0, 2 ** 32), st.booleans())
@settings(max_examples=60, deadline=None)
def test_coder_round_trip(n, k, seed, skewed):
    rng = np.random.default_rng(seed)
    sym = (rng.pareto(0.7, n).astype(np.int64) if skewed else rng.integers(0, k, n)) % k
    counts = np.bincount(sym, minlength=k) + 1.0
    model = Model(quantised(counts))
    coded = encode(sym, model)
    assert decode(coded, n, model).tolist() == sym.tolist()
    a, b = sorted(rng.integers(0, n + 1, 2).tolist())
    assert decode(coded, n, model, a, b).tolist() == sym[a:b].tolist()


def test_coder_at_its_bounds():
    one = Model(quantised(np.array([7.0])))
    assert decode(encode(np.zeros(1000, int), one), 1000, one).tolist() == [0] * 1000
    rng = np.random.default_rng(2)
    sym = np.minimum(rng.pareto(1.0, 600_000), 49_999).astype(np.int64)
    counts = np.bincount(sym, minlength=50_000).astype(float)
    model = Model(quantised(counts))
    coded = encode(sym, model)
    assert lanes_for(len(sym)) == coded.lanes == 1024 and len(coded.places) == -(-len(sym) // (1024 * CHECK_STEPS)) > 1
    assert (decode(coded, len(sym), model) == sym).all()
    assert (decode(coded, len(sym), model, 500_000, 500_100) == sym[500_000:500_100]).all()
    p = counts[counts > 0] / len(sym)
    bits = 8 * (coded.words.nbytes + coded.states.nbytes)
    assert bits < 1.15 * len(sym) * -(p * np.log2(p)).sum()                    # near the entropy
    with pytest.raises(ValueError):
        quantised(np.ones(5000), 12)


def test_slots():
    for counts in ([1.0], [1.0, 1e15], [3.0] * 1000, list(range(1, 5000))):
        slots = quantised(np.array(counts))
        assert slots.min() >= 1 and int(slots.sum()).bit_count() == 1


def test_checksums_of_pieces():
    data = bytes(range(256)) * 9
    for cut in (0, 1, 4, 777, len(data)):
        a, b = data[:cut], data[cut:]
        assert crc32_before(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(data)


def _plain(docs, tok):
    """doc_id -> (start, n, crc), from the library's ids in order."""
    out, at = {}, 0
    for d in sorted(docs):
        ids = tok.encode(docs[d] or "", add_special_tokens=False).ids + [2]
        out[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4")))
        at += len(ids)
    return out


def test_query(spark, tok):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op11_token_files"](spark, SF_SMALL).collect()}
    assert got == _plain(docs, tok)


def test_files(spark, tok):
    """Small blocks and parts: documents over several blocks, ranges, damage."""
    docs = dict(enumerate(HARD)) | {100: None, 101: "x y z " * 2000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    files = write_token_files(df, part_bytes=5000, block_ids=700)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in files.documents().collect()}
    assert got == _plain(docs, tok)
    blocks = files.blocks().collect()
    assert max(r["n_ids"] for r in blocks) <= 700 and len({r["part"] for r in blocks}) > 3
    whole = [i for d in sorted(docs) for i in tok.encode(docs[d] or "", add_special_tokens=False).ids + [2]]
    pieces = sorted((r["start"] + r["at"], r["ids"]) for r in files.tokens().collect())
    assert sum((p for _, p in pieces), []) == whole
    again = TokenFiles(spark, files.path)
    for start, n in ((0, 1), (650, 100), (1, len(whole)), (len(whole) - 3, 50), (len(whole), 5), (5, 0)):
        found = sorted((r["start"], r["ids"]) for r in again.read(start, n).collect())
        assert sum((p for _, p in found), []) == whole[start:start + n]
    bad = files.blocks().withColumn("words_crc32", F.col("words_crc32") + 1)
    again.blocks = lambda: bad
    with pytest.raises(Exception, match="damaged block"):
        again.documents().collect()


def test_odd_rows(spark, tok):
    rows = [(None, "a b", 1), (None, "a b", 1), (3, "x", 2), (3, "y z", 2), (3, "x", 2), (1, None, 3), (2, "", 3)]
    df = spark.createDataFrame(rows, "id long, body string, start long")
    got = sorted(((r["doc_id"] or 0, r["start"], r["n_tokens"]) for r in token_file_report(df, "id", "body").collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == [0, 0, 1, 2, 3, 3, 3]                       # null ids first, then ascending
    assert [g[1] for g in got] == np.cumsum([0] + [g[2] for g in got[:-1]]).tolist()
    assert sorted(g[2] for g in got) == sorted(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert token_file_report(df.limit(0), "id", "body").collect() == []
    assert write_token_files(df.limit(0), id_col="id", text_col="body").read(0, 5).collect() == []


def test_very_long_texts(spark, tok):
    docs = {1: " " * 2_000_000, 2: "a" * 300_000, 3: "ab cd " * 200_000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_file_report(df).collect()}
    assert got == _plain(docs, tok)
