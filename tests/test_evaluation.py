"""End-to-end run: synthetic source + constant model, and a JSONL source
with a registered batch model and a cap."""

import pandas as pd
import pytest

from qaspark.operators import infer as inf
from qaspark.plans.evaluation import evaluate_grid, evaluate_run
from qaspark.sources.qa_jsonl import read_qa, synthetic_items


def _no_cross_product(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_synthetic_constant_run(spark):
    preds, metrics = evaluate_run(synthetic_items(spark), model={"name": "const", "model_type": "constant"},
                                  dataset={"name": "synthetic"}, mode={"name": "no_context"})
    assert _no_cross_product(metrics) and _no_cross_product(preds)
    m = metrics.first()
    assert (m.run_id, m.num_examples, m.dataset_eval_size) == ("const_synthetic_no_context", 10, 10)
    assert m.substring_recall == pytest.approx(2 / 3) and m.token_recall == pytest.approx(2 / 3)
    p = preds.orderBy("question_id").first()
    assert (p.question_id, p.predicted_answer, p.ground_truth) == ("0", "Test answer", ["Test answer 0"])
    assert (p.metadata.dataset, p.metadata.id) == ("synthetic", "0")
    assert p.metadata.token_recall_tokens == pytest.approx(2 / 3) == p.token_recall


def test_jsonl_run_with_model_and_cap(spark, tmp_path):
    f = tmp_path / "qa.jsonl"
    f.write_text('{"question_id":1,"question":"capital of France?","answer":["Paris"]}\n'
                 '{"question_id":2,"question":"2+2?","answer":"4"}\n'
                 '{"question_id":3,"question":"","answer":"x"}\n'
                 '{"question_id":4,"question":"sky?","answer":"blue"}\n', encoding="utf-8")
    inf.MODELS["lookup"] = lambda cfg: (lambda prompts: pd.Series(
        ["<think>hmm</think> It is Paris." if "France" in p else "four" for p in prompts]))
    try:
        mode = {"name": "no_context", "prompt_template": "Q: {question}", "max_samples": 2}
        preds, metrics = evaluate_run(read_qa(spark, str(f)), model={"name": "m", "model_type": "lookup"},
                                      dataset={"name": "d"}, mode=mode)
        rows = {r.question_id: r for r in preds.collect()}
        assert set(rows) == {"1", "2"}                                  # cap 2, first valid in file order
        assert rows["1"].predicted_answer == "It is Paris." and rows["1"].token_recall == 1.0
        assert rows["1"].prompt == "Q: capital of France?"
        assert rows["2"].token_recall == 0.0
        m = metrics.first()
        assert (m.num_examples, m.dataset_eval_size, m.dataset_valid_count, m.dataset_to_process) == (2, 4, 3, 2)
        assert m.token_recall == 0.5
        assert m.duration_seconds >= 0.0 and m.cpu_ram_used_mb > 0.0          # generation telemetry
        assert m.model_size_bytes == 0 and m.retriever_index_size_bytes == 0
    finally:
        inf.MODELS.pop("lookup")


def test_chat_model_prompt_is_messages(spark):
    preds, _ = evaluate_run(synthetic_items(spark, 2), model={"name": "c", "model_type": "constant",
                                                              "model_path": "org/Qwen3-0.6B"},
                            dataset={"name": "s"}, mode={"name": "no_context", "prompt_template": "T {question}"},
                            system_prompt="S")
    assert preds.first().prompt.startswith('[{"role":"system","content":"S"},{"role":"user","content":"T Test question')


def test_grid_many_runs_one_job(spark):
    from pyspark.sql import functions as F
    from qaspark.operators.grid import run_grid
    from qaspark.sources.qa_jsonl import synthetic_items
    items = (synthetic_items(spark, 6).withColumn("dataset", F.lit("syn"))
             .unionByName(synthetic_items(spark, 3).withColumn("dataset", F.lit("small"))))
    ms = spark.createDataFrame([("const", "const"), ("upper", "upper")], "model string, model_stem string")
    ds = spark.createDataFrame([("syn", "syn"), ("small", "small"), ("empty", "empty")],
                               "dataset string, dataset_stem string")
    grid = run_grid(ms, ds, "no_context")                           # the one product, by definition
    grid = spark.createDataFrame(grid.collect(), grid.schema)
    inf.MODELS["upper"] = lambda cfg: (lambda prompts: prompts.str.upper())
    try:
        models = {"const": {"model_type": "constant"}, "upper": {"model_type": "upper"}}
        preds, metrics = evaluate_grid(items, grid, models, {"name": "no_context", "max_samples": 5})
        assert _no_cross_product(metrics) and _no_cross_product(preds)
        m = {r.run_id: r for r in metrics.collect()}
        assert len(m) == 6
        c = m["const_syn_no_context"]
        assert (c.num_examples, c.dataset_eval_size, c.dataset_to_process) == (5, 6, 5)
        assert c.token_recall == pytest.approx(2 / 3)
        assert m["const_small_no_context"].num_examples == 3
        e = m["upper_empty_no_context"]
        assert (e.num_examples, e.token_recall, e.substring_recall) == (0, 0.0, 0.0)
        assert c.model_size_bytes == 1024 and e.model_size_bytes == 0
        up = m["upper_syn_no_context"]          # "QUESTION: TEST QUESTION i ANSWER:" vs "Test answer i"
        assert up.token_recall == 1.0 and up.num_examples == 5
        assert preds.filter("run_id = 'upper_syn_no_context'").count() == 5
        assert up.duration_seconds >= 0.0 and up.cpu_ram_used_mb > 0.0 and e.duration_seconds == 0.0
    finally:
        inf.MODELS.pop("upper")


def test_run_with_retrieved_contexts(spark):
    from pyspark.sql import functions as F
    from qaspark.operators.retrieve import attach_contexts, retrieve_lexical
    corpus = spark.createDataFrame([(1, "Paris is the capital of France"), (2, "Berlin is in Germany"),
                                    (3, "The sky is blue")], "doc_id long, text string")
    items = synthetic_items(spark, 1).withColumn("question", F.lit("capital of France"))
    q = items.select(F.lit(0).cast("long").alias("qid"), "question")
    ctx = attach_contexts(retrieve_lexical(q, corpus, "qid", "question", "doc_id", "text", k=2),
                          corpus, "doc_id", "text", 2)
    items = (items.withColumn("__k", F.lit(0).cast("long"))
             .join(ctx.withColumnRenamed("query_id", "__k"), "__k").drop("__k", "scores"))
    preds, _ = evaluate_run(items, model={"name": "c", "model_type": "constant"}, dataset={"name": "s"},
                            mode={"name": "ctx", "prompt_template": "C: {context} Q: {question}"})
    p = preds.first()
    assert p.contexts[0] == "Paris is the capital of France" and len(p.contexts) == 2
    assert p.prompt.startswith("C: Paris is the capital of France\n") and p.prompt.endswith("Q: capital of France")


def test_grid_failing_row_gets_sentinel(spark):
    from pyspark.sql import functions as F
    from qaspark.operators.grid import run_grid

    def flaky(cfg):
        def gen(prompts):
            if prompts.str.contains("question 2").any():
                raise RuntimeError("model fault")
            return prompts.str.lower()
        return gen
    inf.MODELS["flaky"] = flaky
    try:
        items = synthetic_items(spark, 4).withColumn("dataset", F.lit("syn"))
        grid = run_grid(spark.createDataFrame([("f", "f")], "model string, model_stem string"),
                        spark.createDataFrame([("syn", "syn")], "dataset string, dataset_stem string"), "m")
        preds, metrics = evaluate_grid(items, grid, {"f": {"model_type": "flaky"}}, {"name": "m"})
        got = {r.question_id: r.predicted_answer for r in preds.collect()}
        assert got["2"] == "Error generating answer"                    # only the failing row
        assert got["0"] == "question: test question 0 answer:" and len(got) == 4
        assert metrics.first().num_examples == 4                        # the sentinel is still scored
    finally:
        inf.MODELS.pop("flaky")
