"""Suffix arrays against sorted suffixes, and byte repeats against a plain-Python version."""

import random

import numpy as np
import pytest

from qaspark.llm import suffix_array as S
from qaspark.llm import suffix_dedup as D
from tests.conftest import SF_SMALL
from tests.llm import brute


def _rows(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("letters", [1, 2, 3, 7])
def test_suffix_array_and_prefixes(letters):
    rng = np.random.default_rng(letters)
    for n in (0, 1, 2, 3, 9, 40, 90):
        for kind in range(4):
            body = rng.integers(1, letters + 1, n)
            body = {0: body, 1: np.sort(body), 2: np.sort(body)[::-1], 3: np.resize(body[:max(1, n // 5)], n)}[kind]
            s = np.append(body, 0).astype(np.uint8)
            sa = S.suffix_array(s, letters + 1)
            assert sa.tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())
            lcp = S.permuted_prefixes(s, sa, 20)
            for a, b in zip(sa[1:], sa[:-1]):
                x, y = s[a:].tolist(), s[b:].tolist()
                k = 0
                while k < min(len(x), len(y), 20) and x[k] == y[k]:
                    k += 1
                assert lcp[a] == k


def test_query_equals_brute_force(spark):
    from qaspark.llm.queries import QUERIES
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    want = brute.repeated_bytes(docs)
    assert _rows(QUERIES["op7_suffix_array_dedup"](spark, SF_SMALL)) == want
    assert any(n for _, n, _, _ in want.values())


@pytest.mark.parametrize("hot", [D.HOT_KINDS, 1])
def test_boundaries_periods_nulls_and_repeated_rows(spark, hot, monkeypatch):
    monkeypatch.setattr(D, "SHARD_BYTES", 3000)
    rng = random.Random(5)

    def chars(n):
        return "".join(rng.choice("abcdefgh é\n\0") for _ in range(n))
    common, edge, short = chars(180), "x" + "".join(rng.choice("pqrstuv") for _ in range(99)), "".join(rng.choice("klmn") for _ in range(99))
    docs = {i: chars(rng.randrange(0, 60)) + common[rng.randrange(0, 40):] + chars(rng.randrange(0, 60)) for i in range(40)}
    docs[100], docs[99] = chars(20) + edge, edge + chars(20)
    docs[102], docs[103] = chars(5) + short + "A", "B" + short + chars(5)            # one byte too short
    docs[104], docs[105] = "ab" * 300, "=" * 700                                     # overlapping themselves
    docs[106], docs[107], docs[108] = None, "", "z"
    docs[109] = common + chars(7) + common
    docs[110] = chars(3000)
    docs[111] = docs[110]
    rows = [(d, t, 1, "x") for d, t in docs.items()]
    df = spark.createDataFrame(rows, "k long, body string, runs int, spans string").repartition(5)
    want = brute.repeated_bytes(docs)
    assert _rows(D.suffix_dedup(df, "k", "body", hot_kinds=hot)) == want
    odd = spark.createDataFrame([(None, docs[110], 1, "x")], df.schema)
    again = D.suffix_dedup(df.unionAll(df).unionAll(odd), "k", "body", hot_kinds=hot)
    got = _rows(again)
    assert again.count() == 2 * len(docs) + 1 and got.pop(None)[1] == 0 and got == want
    assert D.suffix_dedup(df.limit(0), "k", "body").collect() == []


def test_long_texts_in_chunks(spark, monkeypatch):
    rng = random.Random(6)
    docs = {i: "".join(rng.choice("abcdefgh") for _ in range(900)) for i in range(3)}
    docs[1] = docs[0][:450] + docs[1][:30] + docs[0][300:]
    want = brute.repeated_bytes(docs)
    monkeypatch.setattr(D, "CHUNK", 128)
    runs = {d: D._runs(np.frombuffer(t.encode(), np.uint8), 100) for d, t in docs.items()}
    for d, (anchor, run, first, n) in runs.items():
        assert first[0] == 0 and (first[1:] == first[:-1] + n[:-1]).all() and first[-1] + n[-1] == len(docs[d]) - 99
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert _rows(D.suffix_dedup(df)) == want


def test_one_id_with_several_texts(spark):
    rng = random.Random(8)
    text = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (150, 400, 60, 300)]
    rows = [(1, text[0]), (1, text[1] + text[0]), (2, text[0] + text[2]), (2, text[3]), (2, text[3]), (None, text[0]), (3, None), (3, "")]
    got = sorted(tuple(r) for r in D.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).na.fill(-1, ["doc_id"]).collect())
    apart = sorted({(d, t or "") for d, t in rows if d is not None}, key=lambda r: (r[0], brute.sha(r[1])))
    want = brute.repeated_bytes(dict(enumerate(t for _, t in apart)))
    expected = [(d, *want[apart.index((d, t or ""))]) for d, t in rows if d is not None] + [(-1, 150, 0, 0, brute.sha(text[0]))]
    assert got == sorted(expected)


def test_short_texts_are_scanned_in_blocks(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (0, 99, 100, 101, 0, 0, 450, 5, 40_000, 0, 300, 98)]
    texts += [texts[6][30:] + texts[10], "=" * 260, texts[6]] + ["".join(rng.choice("abc ") for _ in range(rng.randrange(260))) for _ in range(200)]
    texts = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    calls, of = [], D.anchored_runs
    monkeypatch.setattr(D, "anchored_runs", lambda *a: calls.append(1) or of(*a))
    got = D._runs_of(texts, 100).to_pylist()
    assert len(calls) <= 5
    for t, runs in zip(texts, got):
        anchor, run, first, n = D._runs(t, 100)
        assert [tuple(r.values()) for r in runs] == list(zip(anchor.view(np.int64).tolist(), run.view(np.int64).tolist(), first.tolist(), n.tolist()))
        assert n.sum() == max(0, len(t) - 99)
    assert got[6] == got[14] and D._runs_of([], 100).to_pylist() == []


def test_only_tied_suffixes_are_sorted_again(monkeypatch):
    rng = np.random.default_rng(10)
    body = rng.integers(1, 5, 3000)
    s = np.concatenate((body, body[:400], [0])).astype(np.uint8)
    sizes, of = [], np.argsort
    monkeypatch.setattr(S.np, "argsort", lambda a, **k: sizes.append(len(a) * (a.dtype == np.int64)) or of(a, **k))
    sa = S.suffix_array(s, 5)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    small = S.classify(s)
    assert 0 < sum(sizes) < 3 * (small[1:] & ~small[:-1]).sum()
    whole, some = S.permuted_prefixes(s, sa, 20), S.permuted_prefixes(s, sa, 20, 12)
    assert (whole >= 12).any() and np.array_equal(some[whole >= 12], whole[whole >= 12]) and (some[whole < 12] <= whole[whole < 12]).all()
