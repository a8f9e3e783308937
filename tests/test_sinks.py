"""Sinks write with Spark's writers and read back the same rows."""

from pyspark.sql import functions as F

from qaspark.sinks import writers as W


def test_predictions_metrics_series_roundtrip(spark, tmp_path):
    root = str(tmp_path / "out")
    preds = spark.createDataFrame(
        [("r1", "1", "q", ["a"], "a"), ("r1", "2", "q2", ["b", "c"], "x"), ("r2", "1", "q", ["a"], "a")],
        "run_id string, question_id string, question string, ground_truth array<string>, predicted_answer string")
    W.write_predictions(preds, root)
    back = spark.read.json(f"{root}/predictions")
    assert back.count() == 3 and set(back.columns) >= {"run_id", "question_id", "ground_truth", "predicted_answer"}
    # rerun of one run replaces only that run's folder
    W.write_predictions(preds.filter(F.col("run_id") == "r1").limit(1), root)
    assert spark.read.json(f"{root}/predictions").groupBy("run_id").count().orderBy("run_id").collect()[0][1] == 1

    metrics = spark.createDataFrame([("r1", 0.5, 0.25, 2)], "run_id string, substring_recall double, "
                                    "token_recall double, num_examples bigint")
    W.write_run_metrics(metrics, root)
    m = spark.read.json(f"{root}/metrics").first()
    assert (m.run_id, m.substring_recall, m.format_version) == ("r1", 0.5, "1.0")

    series = spark.createDataFrame([("r1", "memory/model x", "cpu ram", 0, 1.5)],
                                   "run_id string, title string, series string, iteration bigint, value double")
    W.write_series(series, root)
    s = spark.read.option("header", True).csv(f"{root}/series").first()
    assert (s.title, s.series) == ("memory_model_x", "cpu_ram")

    cfg = spark.createDataFrame([("r1", "m", 0.7)], "run_id string, model string, temperature double")
    W.write_run_config(cfg, root)
    assert spark.read.json(f"{root}/config").first().config == '{"model":"m","temperature":0.7}'

    man = W.manifest_rows(spark.createDataFrame([("metrics", "/a/m.json", f"{root}/metrics", "m_d")],
                                                "n string, p string, s string, experiment string"), "n", "p", "s")
    W.append_manifest(man, root)
    assert spark.read.parquet(f"{root}/artifacts").first().experiment == "m_d"


def test_single_values_last_write_wins(spark, tmp_path):
    vals = spark.createDataFrame([("r", "eval_size", 1.0, 1), ("r", "eval_size", 3.0, 3), ("r", "eval_size", 2.0, 2), ("r", "x", 5.0, 1)],
                                 "run_id string, name string, value double, ts int")
    W.write_single_values(vals, str(tmp_path), ["name"])
    got = {r.name: r.latest_value for r in spark.read.json(str(tmp_path / "single_values")).collect()}
    assert got == {"eval_size": 3.0, "x": 5.0}


def test_previews(spark):
    from qaspark.operators.sequence import previews
    preds = spark.createDataFrame([(i % 2, i, None if i % 3 else f"p{i}") for i in range(300)],
                                  "run int, i int, prompt string")
    head, prompts = previews(preds, ["run"], ["i"])
    assert head.count() == 200 and prompts.count() == 40
    assert {r.n_more for r in head.collect()} == {50} and {r.n_more for r in prompts.collect()} == {30}


def test_telemetry_tables_and_text_log(spark, tmp_path):
    root = str(tmp_path / "out")
    samples = spark.createDataFrame([("r1", 1, 10.0), ("r1", 2, 30.0), ("r2", 1, 5.0)],
                                    "run_id string, seq int, cpu_ram_used_mb double")
    peaks = samples.groupBy("run_id").agg(F.max("cpu_ram_used_mb").alias("cpu_ram_used_mb"))
    sp, pp = W.write_telemetry(samples, peaks, root)
    assert spark.read.parquet(sp).count() == 3
    assert {r.run_id: r.cpu_ram_used_mb for r in spark.read.parquet(pp).collect()} == {"r1": 30.0, "r2": 5.0}
    t = W.write_table(spark.createDataFrame([("r1", 1, "a")], "run_id string, i int, s string"), root, "preview/predictions 1")
    assert t.endswith("tables/preview_predictions_1/0") and spark.read.parquet(t).count() == 1
    log = spark.createDataFrame([("r1", "started")], "run_id string, text string").withColumn("ts", F.current_timestamp())
    W.write_text_log(log, root)
    W.write_text_log(log, root)                                   # appends
    assert spark.read.parquet(f"{root}/log").count() == 2


def test_runs_never_erase_each_other_and_reruns_replace_their_own(spark, tmp_path):
    root = str(tmp_path / "out")

    def write(run, v):
        metrics = spark.createDataFrame([(run, v)], "run_id string, token_recall double")
        W.write_run_metrics(metrics, root)
        W.write_run_config(metrics, root)
        W.write_telemetry(metrics, metrics, root)
        W.write_series(spark.createDataFrame([(run, "a b", "s/t", 0, v)], "run_id string, title string, series string, iteration long, value double"), root)
        W.write_single_values(spark.createDataFrame([(run, "n", v, 1)], "run_id string, name string, value double, ts int"), root, ["name"])
        W.write_table(metrics, root, "t", series="x y", iteration=3)
        W.write_predictions(spark.createDataFrame([(run, "1", "q", ["a"], str(v))], "run_id string, question_id string, question string, "
                                                  "ground_truth array<string>, predicted_answer string"), root)
    for run, v in (("r1", 1.0), ("r2", 2.0), ("r1", 3.0)):
        write(run, v)
    want = {"r1": 3.0, "r2": 2.0}
    for path, col in (("metrics", "token_recall"), ("series_json", "value"), ("single_values", "latest_value"), ("predictions", "predicted_answer")):
        assert {r.run_id: float(r[col]) for r in spark.read.json(f"{root}/{path}").collect()} == want, path
        assert spark.read.json(f"{root}/{path}").count() == 2
    for path in ("telemetry/samples", "telemetry/peaks", "tables/t/x_y/3"):
        assert sorted((r.run_id, r.token_recall) for r in spark.read.parquet(f"{root}/{path}").collect()) == sorted(want.items())
    assert {r.run_id: r.value for r in spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/series").collect()} == want
    assert {r.run_id: r.config for r in spark.read.json(f"{root}/config").collect()}["r1"] == '{"token_recall":3.0}'
    record = {r.run_id: r for r in spark.read.json(f"{root}/table_records/t/x_y/3").collect()}["r2"]
    assert (record.title, record.series, record.iteration, record["columns"], record.n_rows) == ("t", "x y", 3, ["token_recall"], 1)
    m = spark.read.json(f"{root}/metrics").first()
    assert m.experiment_name == m.run_id and m.format_version == "1.0"
