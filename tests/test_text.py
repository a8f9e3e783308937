"""Golden rows for the word rules, both recalls and the answer clean-up."""

import pytest
from pyspark.sql import functions as F

from qaspark.functions.text import clean_answer, collapse_ws, sanitize_series, tokens, with_recalls, words

# (predicted, truths, token recall, substring recall) -- FIXTURES.md 3.1
RECALL_ROWS = [
    ("Paris, France", ["Paris"], 1.0, 1.0),
    ("concatenate", ["cat"], 0.0, 1.0),
    ("a b", ["a a c"], 1 / 2, 2 / 3),
    ("a a b", ["a a c"], 1 / 2, 2 / 3),
    ("anything", ["!!!"], 0.0, 0.0),
    ("x", ["x y", "x"], 1.0, 1.0),
    ("No answer generated", ["No"], 1.0, 1.0),
    ("dont", ["Don't"], 0.0, 1.0),
    ("ÉLAN vital", ["Élan"], 1.0, 1.0),
    ("a b", ["a_b"], 0.0, 0.0),
    ("½ cup", ["½"], 1.0, 1.0),
    ("हिन्दी", ["हिन्दी"], 1.0, 1.0),
    ("in 1,990", ["1990"], 0.0, 0.0),
    ("ΣΑΣ", ["σας"], 1.0, 1.0),
    ("", ["a"], 0.0, 0.0),
    ("New York City", ["new york", "Boston"], 1.0, 1.0),
]


def test_recall_golden(spark):
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _, _) in enumerate(RECALL_ROWS)],
                               "i int, p string, t array<string>")
    got = {r.i: (r.token_recall, r.substring_recall) for r in with_recalls(df, "p", "t").collect()}
    for i, (_, _, tok, sub) in enumerate(RECALL_ROWS):
        assert got[i] == pytest.approx((tok, sub)), RECALL_ROWS[i]


def test_empty_and_null_truths(spark):
    df = spark.createDataFrame([("a", []), ("a", None), ("a", [None, ""]), ("a", [" "])],
                               "p string, t array<string>")
    rows = with_recalls(df, "p", "t").collect()
    assert [(r.token_recall, r.substring_recall) for r in rows] == [(0.0, 0.0)] * 4


def test_words_and_tokens(spark):
    r = spark.createDataFrame([("The the THE, a_b ½!",)], "t string").select(
        words("t").alias("w"), F.sort_array(tokens("t")).alias("s")).first()
    assert r.w == ["the", "the", "the", "a_b", "½"]
    assert r.s == sorted(["the", "a_b", "½"])


CLEAN_ROWS = [
    ("  <think>x\ny</think> Paris ", "Paris"),
    ("<THINK/>a", "a"),
    ("a <think> unclosed", "a unclosed"),
    ("<think></think>", "No answer generated"),
    ("First, it is Rome", "it is Rome"),
    ("first,!!", "first,!!"),
    ("Let me think... It is 5", "It is 5"),
    ("Step-by-Step Explanation:\n 1. foo", "1. foo"),
    ("\u001c  ok ", "ok"),
    (None, "No answer generated"),
]


def test_clean_golden(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEAN_ROWS)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean_answer("t").alias("c")).collect()}
    for i, (_, want) in enumerate(CLEAN_ROWS):
        assert got[i] == want, CLEAN_ROWS[i]


def test_collapse_and_sanitize(spark):
    r = spark.createDataFrame([("a \t　 b ", "memory/model x")], "a string, b string").select(
        collapse_ws("a").alias("a"), sanitize_series("b").alias("b")).first()
    assert (r.a, r.b) == ("a b", "memory_model_x")


def test_recall_properties(spark):
    """recall in [0,1]; recall(x, [x]) = 1 when x has a word; adding a truth
    never lowers the max."""
    texts = ["a b c", "Hello, World!", "x", "1 2 2 3", "über straße", "!!!"]
    rows = [(p, [t]) for p in texts for t in texts] + [(p, [t, "zzz"]) for p in texts for t in texts]
    df = spark.createDataFrame(rows, "p string, t array<string>")
    out = with_recalls(df, "p", "t").collect()
    single = {}
    for r in out:
        assert 0.0 <= r.token_recall <= 1.0 and 0.0 <= r.substring_recall <= 1.0
        if len(r.t) == 1:
            single[(r.p, r.t[0])] = (r.token_recall, r.substring_recall)
            if r.p == r.t[0] and r.p != "!!!":
                assert r.token_recall == 1.0 and r.substring_recall == 1.0
    for r in out:
        if len(r.t) == 2:
            base = single[(r.p, r.t[0])]
            assert r.token_recall >= base[0] and r.substring_recall >= base[1]
