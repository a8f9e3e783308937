"""Contaminated passages: verbatim, edited and chance ones, and an all-pairs version."""

import random

import numpy as np

from qaspark.llm import decontaminate as D
from qaspark.llm.queries import QUERIES
from qaspark.sources.tables import table
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, score int, gram long"


def _plain_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if x == y else D.MISMATCH), h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_plain_dynamic_programme():
    rng = np.random.default_rng(3)
    pairs = [(rng.integers(0, 6, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64)) for _ in range(60)]
    score, end = D.align([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), s, e in zip(pairs, score.tolist(), end.tolist()):
        assert s == _plain_alignment(a.tolist(), b.tolist())
        assert s == _plain_alignment(a.tolist(), b.tolist()[:e])


def test_query_equals_all_pairs_alignment(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, SF_SMALL, "documents").collect()}
    items = {r["item_id"]: r["text"] for r in table(spark, SF_SMALL, "benchmark").collect()}
    words = {d: D._words(np.frombuffer(t.lower().encode(), np.uint8))[0] for d, t in docs.items()}
    want = set()
    for i, t in items.items():
        h = D._words(np.frombuffer(t.lower().encode(), np.uint8))[0]
        for d, w in words.items():
            for a in range(0, len(w), 4 * len(h)):              # overlapping windows of the whole text
                s, _ = D.align([h], [w[a:a + 6 * len(h)]])
                if s[0] / (D.MATCH * len(h)) >= D.MIN_SCORE:
                    want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_decontamination"](spark, SF_SMALL).collect()}
    assert got == want and got


def test_edited_copies_and_odd_inputs(spark, monkeypatch):
    rng = random.Random(2)
    vocab = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(25))) for i in range(30)] + [(50, None), (51, ""), (None, "x y z"), (52, "tiny item")]
    docs = []
    for i in range(30):
        w = items[i][1].split()
        for k in range(4):                                       # k: words replaced, lost and added
            e = list(w)
            for p in rng.sample(range(25), k):
                e[p] = "edited"
            if k:
                del e[rng.randrange(len(e))]
                e.insert(rng.randrange(len(e)), "added")
            docs.append((100 * i + k, " ".join([rng.choice(vocab) for _ in range(200)] + [x.upper() + "," for x in e] + [rng.choice(vocab) for _ in range(50)]), 1, 1))
    docs += [(9000 + i, " ".join(rng.choice(vocab) for _ in range(300)), 1, 1) for i in range(30)]
    docs += [(9900, None, 1, 1), (9901, "", 1, 1), (None, "a Tiny item!", 1, 1), (9902, "a Tiny item!", 1, 1), (9902, "a Tiny item!", 1, 1), (9903, (items[3][1] + " pad ") * 400, 1, 1)]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_ITEMS", 7)
    rows = D.find_contamination(df, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got == {(100 * i + k, i) for i in range(30) for k in range(4)} | {(None, 52), (9902, 52), (9903, 3)}
    assert len(rows) == len(got) + 1                             # the repeated row
    text = {d: t.lower().encode() for d, t, *_ in docs if t}
    whole = next(r for r in rows if r["doc_id"] == 500 and r["item_id"] == 5)
    assert text[500][whole["start"]:whole["end"]].decode().replace(",", "") == items[5][1] and whole["score"] == 1.0
    assert D.find_contamination(df.limit(0), bench).collect() == []
    assert D.find_contamination(df, bench.limit(0)).collect() == []


def test_one_edited_copy_is_found_in_any_number_of_documents(spark):
    rng = random.Random(4)
    vocab = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    item = " ".join(rng.sample(vocab, 25))
    copy = item.split()
    for p in (4, 8, 12, 16, 20):                                 # 2 of its 22 runs of four words are left
        copy[p] = "edited"
    for n in (4, 5, 1000):
        docs = [(i, " ".join(rng.choice(vocab) for _ in range(20)) + " " + " ".join(copy), 1, 1) for i in range(n)]
        rows = D.find_contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(n))


def test_seeds_find_what_all_pairs_alignment_finds(spark):
    """Short and heavily edited copies: words replaced, lost and added."""
    rng = random.Random(6)
    vocab = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    items = [(n, " ".join(rng.choice(vocab) for _ in range(n))) for n in (2, 3, 4, 5, 8, 12, 16, 25)]
    docs = []
    for n, text in items:
        for k in range(60):
            e = text.split()
            for p in rng.sample(range(n), min(n - 1, rng.randrange(n // 3 + 2))):
                e[p] = "edited"
            if k % 3 == 1:
                del e[rng.randrange(len(e))]
            if k % 3 == 2:
                for _ in range(n // 3):
                    e.insert(rng.randrange(len(e)), "added")
            docs.append((1000 * n + k, " ".join([rng.choice(vocab) for _ in range(6)] + e + [rng.choice(vocab) for _ in range(6)]), 1, 1))
    words = [D._words(np.frombuffer(t.encode(), np.uint8))[0] for _, t, *_ in docs]
    want = set()
    for i, t in items:
        h = D._words(np.frombuffer(t.encode(), np.uint8))[0]
        score, _ = D.align([h] * len(words), words)
        want |= {(d[0], i) for d, s in zip(docs, score.tolist()) if s >= D.MIN_SCORE * D.MATCH * len(h)}
    rows = D.find_contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(want) > 200
