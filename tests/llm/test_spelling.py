"""Spelling variants against plain Python: counts by the letter, neighbours by deletions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from qaspark.llm import spelling
from qaspark.llm.queries import QUERIES
from qaspark.llm.spelling import near_words, spelling_variants
from tests.conftest import SF_SMALL

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_counts(docs, min_length=7, min_count=2, every=31):
    total = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= min_length and n >= min_count}


def plain_near(words):
    """word -> set of near words, through the words left by deleting one code point."""
    by_gap, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_gap[w[:i] + w[i + 1:], i].add(w)                 # replaced at i
            shorter = w[:i] + w[i + 1:]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in by_gap.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain_rows(words):
    near, form = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None)
    return out


def rows_of(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = plain_rows(plain_counts(docs))
    assert any(f[0] for f in want.values()) and max(f[3] for f in want.values()) > 1
    assert rows_of(QUERIES["op13_spelling_variants"](spark, SF_SMALL)) == want


@pytest.mark.parametrize("block_words", [2048, 6])
def test_near_words(spark, block_words):
    """Dense neighbourhoods over few letters, blocks split down to one position."""
    rng = random.Random(block_words)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))): rng.randint(2, 99) for _ in range(600)}
    words |= {"aaaaaaa" + x: 3 for x in ("", "a", "aa", "aaa", "b", "é")}
    words |= {"prefix" + a + b + "suffix": 2 for a in "abcdefghijkl" for b in "abcdefghijkl"}
    words |= {"long" * 300: 5, "long" * 300 + "x": 4, "long" * 150 + "z" + "long" * 150: 4, "lonx" + "long" * 299: 4}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    links, tables = near_words(df, 7, block_words)
    got = [(r["word"], r["near"], r["near_n"]) for r in links.collect()]
    want = {(w, x, words[x]) for w, near in plain_near(words).items() for x in near}
    assert len(got) == len(set(got)) and set(got) == want
    assert (len(tables) > 1) == (block_words == 6)


def test_tiles_of_all_sizes(spark, monkeypatch):
    """The same links by diagonals, by tiles and in small chunks."""
    words = {"word" + a + b + "ending"[i:]: i + 2 for a in "abcdefg" for b in "abcdefg" for i in range(3)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = {(w, x, words[x]) for w, near in plain_near(words).items() for x in near}
    rows = (spelling.first_blocks(df, 7).coalesce(1).sortWithinPartitions("base", "lo", "hi", "key").toArrow())
    for small, tile, cells, batch in ((24, 128, 1 << 24, 10_000), (1, 3, 1 << 24, 7), (3, 2, 40, 1), (100, 8, 200, 1000)):
        monkeypatch.setattr(spelling, "SMALL", small)
        monkeypatch.setattr(spelling, "TILE", tile)
        monkeypatch.setattr(spelling, "CELLS", cells)
        got = [tuple(r.values()) for b in spelling._tiles(iter(rows.to_batches(batch))) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want, (small, tile, cells, batch)


def test_forms_and_roots(spark):
    """Chains of forms, ties, and a count just short of ten times."""
    text = (["formidable"] * 1000 + ["formidible"] * 100 + ["formidiblo"] * 10 + ["fxrmidiblo"] * 2 + ["different"] * 20 + ["diffferent"] * 2
            + ["tiewordb"] * 30 + ["tieworda"] * 30 + ["tiewordx"] * 3 + ["shortby"] * 19 + ["shortbx"] * 2 + ["singleone"])
    rows = [(i, " ".join(text[i::7])) for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(spelling_variants(df, every=1 << 40))                        # nothing is deleted
    assert got == plain_rows(plain_counts(rows, every=1 << 40))
    assert got["tiewordx"][:2] == ("tieworda", "tieworda") and got["shortbx"][0] is None and got["diffferent"][0] == "different"
    assert [got["formidiblo"][0], got["formidiblo"][1]] == ["formidible", "formidable"]
    assert got["fxrmidiblo"][:2] == (None, "fxrmidiblo")                      # five times as often is not enough


def test_odd_rows(spark):
    big = "q" * 2000
    rows = [(None, "Straße ÉCOLES écoles ÉCOLES", "a", 1), (1, None, "a", 1), (2, "", "a", 1), (3, "naïvement × naïvemont÷x naïvement", "a", 1),
            (3, "naïvement × naïvemont÷x naïvement", "a", 1), (4, f"{big} {big} {big}x {big}x {'ab' * 1000}", "a", 1), (5, "日本語日本語日本語 " * 3, "a", 1),
            (6, " " * 100_000 + "wordwords wordwords\nWORDWORDS", "a", 1)]
    df = spark.createDataFrame(rows, "id long, body string, word string, n int")
    assert rows_of(spelling_variants(df, "id", "body")) == plain_rows(plain_counts([(r[0], r[1]) for r in rows]))
    assert spelling_variants(df.limit(0), "id", "body").collect() == []
    assert spelling_variants(df.filter("body IS NULL"), "id", "body").collect() == []


def test_very_long_words(spark):
    big = "pq" * 150_000
    rows = [(1, f"{big} {big} {big}x {big}x {'ab' * 700_000} wordwords wordwords")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(spelling_variants(df, every=1 << 40))
    assert got == {big: (None, big, 2, 1, None), big + "x": (None, big + "x", 2, 1, None), "wordwords": (None, "wordwords", 2, 0, None)}
