"""Golden rows for naming, memory estimate, metric category/format, grid."""

import pytest
from pyspark.sql import functions as F

from qaspark.functions.naming import (bucket_name, file_stem, memory_estimate_gb, results_path,
                                      split_object_path)
from qaspark.operators.aggregate import flatten_config, format_metric, metric_category, metrics_long
from qaspark.operators.grid import order_by_memory, run_grid, with_memory_estimate
from qaspark.sinks.writers import object_result_path


def test_memory_estimate(spark):
    rows = [("0.6B", "any"), ("1.7B", "any"), ("135M", "smollm2_135m"), ("360M", "smollm2_360m"),
            ("4M", "other"), ("foo", "other")]
    df = spark.createDataFrame(rows, "s string, n string")
    got = [r.e for r in df.select(memory_estimate_gb("s", "n").alias("e")).collect()]
    assert got == [1.5, 4.25, 2.0, 4.0, 9.0, 3.0]


def test_names_and_paths(spark):
    df = spark.createDataFrame([("a/b\\c", "no_context", "s3://no-context/run/x.json")], "a string, m string, p string")
    b, k = split_object_path("p")
    r = df.select(file_stem("a").alias("stem"), bucket_name("m").alias("bucket"), b.alias("b"), k.alias("k"),
                  results_path("s3", F.lit("no-context"), F.lit("m_d_no_context"), F.lit("metrics")).alias("path")
                  ).first()
    assert (r.stem, r.bucket, r.b, r.k) == ("a_b_c", "no-context", "no-context", "run/x.json")
    want = "s3://no-context/m_d_no_context/experiment_results/m_d_no_context_metrics.json"
    assert r.path == want == object_result_path("s3", "no-context", "m_d_no_context", "metrics")


def test_metric_category_and_format(spark):
    names = ["token_recall", "cpu_ram_used_mb", "model_size_bytes", "duration_seconds", "num_parameters"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.c for r in df.select(metric_category("n").alias("c")).collect()] == \
        ["quality", "memory", "size", "other", "memory"]
    vals = [("model_size_bytes", 1234567.9, "1,234,567"), ("token_recall", 0.5, "0.5000"),
            ("cpu_ram_used_mb", 12.25, "12.25"), ("duration_seconds", 3.0, "3.00"),
            ("num_examples", 10.0, "10"), ("gpu_power_draw_w", 120.5, "120.5000")]
    df = spark.createDataFrame([(n, v) for n, v, _ in vals], "n string, v double")
    assert [r.f for r in df.select(format_metric("n", "v").alias("f")).collect()] == [w for _, _, w in vals]
    wide = spark.createDataFrame([("r", 10)], "run string, dataset_eval_size bigint")
    assert metrics_long(wide, ["run"]).first().display == "10"     # integers print as is


def test_metrics_long_keeps_numbers_only(spark):
    wide = spark.createDataFrame([("r1", 0.5, 10, "text")], "run_id string, token_recall double, n bigint, s string")
    rows = metrics_long(wide, ["run_id"]).collect()
    assert sorted((r.metric, r.value, r.category) for r in rows) == [("n", 10.0, "other"), ("token_recall", 0.5, "quality")]


def test_flatten_config(spark):
    df = spark.createDataFrame([(1, '{"model":{"name":"m","size":"1B"},"seed":1,"note":"{x","empty":{}}')],
                               "id int, c string")
    got = sorted((r.section, r.key, r.value) for r in flatten_config(df, "c", ["id"]).collect())
    assert got == [("model", "name", "m"), ("model", "size", "1B"), ("note", None, "{x"), ("seed", None, "1")]


def test_grid_and_estimates(spark):
    models = spark.createDataFrame([("qwen_0.6b", "qwen_0.6b"), ("big", "big"), ("nosize", "nosize")],
                                   "model string, model_stem string")
    datasets = spark.createDataFrame([("local_nq_full", "local_nq"), ("simple", "local_simple_qa"),
                                      ("m", "local_mirage")], "dataset string, dataset_stem string")
    g = run_grid(models, datasets, "no_context")
    est = spark.createDataFrame([("qwen_0.6b", 1.5), ("big", 20.0)], "model string, estimated_memory_gb double")
    out = order_by_memory(with_memory_estimate(g, est)).collect()
    assert len(out) == 9
    assert [r.estimated_memory_gb for r in out] == [1.5] * 3 + [3.0] * 3 + [20.0] * 3
    r = [x for x in out if x.model == "qwen_0.6b" and x.dataset == "local_nq_full"][0]
    assert r.run_name == "qwen_0.6b_local_nq_full_no_context"
    assert r.task_id == "qwen_0.6b_local_nq_no_context"
    assert r.output_dir == "no_context/qwen_0.6b_local_nq_full_no_context"
    assert r.bucket == "no-context"


def test_grid_is_the_whole_product(spark):
    models = spark.createDataFrame([("a", "a"), ("b", "b")], "model string, model_stem string")
    datasets = spark.range(20).select(F.col("id").cast("string").alias("dataset"),
                                      F.col("id").cast("string").alias("dataset_stem"))
    got = {(r.model, r.dataset) for r in run_grid(models, datasets, "m").collect()}
    assert got == {(m, str(d)) for m in "ab" for d in range(20)}


def test_display_rounds_like_python(spark):
    import random
    from pyspark.sql import functions as F
    from qaspark.operators.aggregate import format_metric
    rng = random.Random(1)
    values = [rng.uniform(-2, 2) * 10 ** rng.randrange(-6, 9) for _ in range(20000)]
    values += [k / 2 ** b for k in range(-400, 401) for b in (3, 5, 6)] + [k / 10 ** 5 for k in range(5, 20000, 10)]
    values += [0.0, -0.0, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", format_metric(F.lit("token_recall"), "v").alias("four"), format_metric(F.lit("duration"), "v").alias("two")).collect()
    for r in rows:
        want = (None, None) if r["v"] is None else (f"{r['v']:.4f}", f"{r['v']:.2f}")
        assert (r["four"], r["two"]) == want, r
