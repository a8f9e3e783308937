"""Golden rows for prompt rendering, chat messages and answer extraction."""

from pyspark.sql import functions as F

from qaspark.functions.prompts import (answer_after_marker, answer_after_prompt, answer_from_chat,
                                       chat_messages, fill_template, is_chat_model, render_prompt)


def test_templates(spark):
    df = spark.createDataFrame([("hi",)], "q string")
    r = df.select(
        fill_template(F.lit("C: {context}\nQ: {question}"), "q", F.array(F.lit("see {question}"), F.lit("b"))).alias("a"),
        fill_template(F.lit("{context} {question}"), "q", F.array().cast("array<string>")).alias("b"),
        render_prompt("q").alias("c"),
        render_prompt("q", F.array(F.lit("c"))).alias("d"),
        render_prompt("q", None, None, F.lit("S")).alias("e"),
    ).first()
    assert r.a == "C: see hi\nb\nQ: hi"
    assert r.b == "{context} hi"
    assert r.c == "Question: hi\nAnswer:"
    assert r.d == "Context: c\n\nQuestion: hi\nAnswer:"
    assert r.e == "S\n\nQuestion: hi\nAnswer:"


def test_chat_messages(spark):
    df = spark.createDataFrame([("Qwen/Qwen3-0.6B", "q")], "path string, q string")
    ctx = F.array(F.lit("c"), F.lit("d"))
    r = df.select(is_chat_model("path").alias("chat"),
                  chat_messages("q", ctx, F.lit("T {question}")).alias("m1"),
                  chat_messages("q", ctx, F.lit("T {question}"), F.lit("S")).alias("m2"),
                  chat_messages("q").alias("m3")).first()
    assert r.chat
    assert [(m.role, m.content) for m in r.m1] == [("system", "Context: c\nd"), ("user", "T q")]
    assert [(m.role, m.content) for m in r.m2] == [("system", "S"), ("user", "T q")]
    assert [(m.role, m.content) for m in r.m3] == [("user", "q")]


def test_answer_extraction(spark):
    df = spark.createDataFrame([("x Answer: y Answer: z", "user q Assistant : hello", "promptANS", "prompt",
                                 "<|im_start|>assistant\nhi<|im_end|> junk")],
                               "a string, b string, c string, p string, d string")
    r = df.select(answer_after_marker("a").alias("a"), answer_from_chat("b").alias("b"),
                  answer_after_prompt("c", "p").alias("c"), answer_from_chat("d").alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("z", "hello", "ANS", "hi")


def test_prompt_edge_cases(spark):
    """Empty template and system prompt count as absent; null contexts are no
    contexts; only the template's placeholders are filled (a question that
    contains "{context}" keeps it)."""
    df = spark.createDataFrame([("q {context}", None)], "q string, ctx array<string>")
    r = df.select(
        render_prompt("q", "ctx", F.lit("")).alias("a"),
        render_prompt("q", "ctx", F.lit("T {context} {question}")).alias("b"),
        render_prompt("q", F.array(F.lit("c")), F.lit("T {context} {question}")).alias("c"),
        render_prompt("q", None, None, F.lit("")).alias("d"),
        chat_messages("q", "ctx", None, F.lit("")).alias("m"),
    ).first()
    assert r.a == "Question: q {context}\nAnswer:"
    assert r.b == "T {context} q {context}"
    assert r.c == "T c q {context}"
    assert r.d == "Question: q {context}\nAnswer:"
    assert [(m.role, m.content) for m in r.m] == [("user", "q {context}")]


def test_extract_answer_without_markers(spark):
    from qaspark.functions.prompts import extract_answer
    df = spark.createDataFrame([("  just text  ", "no-role text")], "a string, b string")
    r = df.select(extract_answer("a").alias("a"), extract_answer("b", None, F.lit(True)).alias("b")).first()
    assert r.a == "just text" and r.b == ""
