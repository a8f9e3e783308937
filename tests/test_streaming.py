"""Stream = batch for the live reports (T1, T2, T3, T4) on the events table."""

import tempfile

from pyspark.sql import functions as F

from qaspark.operators import aggregate as agg
from qaspark.streaming import live
from tests.conftest import SF_SMALL


_STREAM_DIRS = {}


def _stream(spark, name):
    """The table as a stream of several small parquet files (the file source
    reads folders, so the table is split into one in a scratch folder)."""
    if name not in _STREAM_DIRS:
        d = tempfile.mkdtemp(prefix=f"qaspark-stream-{name}-")
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(4).write.mode("overwrite").parquet(f"{d}/t")
        _STREAM_DIRS[name] = f"{d}/t"
    schema = spark.read.parquet(_STREAM_DIRS[name]).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(_STREAM_DIRS[name])


def _run(q):
    q.processAllAvailable()
    q.stop()


def test_latest_values_stream_equals_batch(spark, tmp_path):
    s = live.latest_values(_stream(spark, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"])
    _run(live.to_memory(s, "t4_latest", "complete", str(tmp_path / "c4")))
    got = {tuple(r) for r in spark.table("t4_latest").collect()}
    b = agg.latest_value(spark.read.parquet(f"{SF_SMALL}/events.parquet"), ["user_id", "event_type"], "value",
                         ["ts", "event_id"])
    assert got == {tuple(r) for r in b.collect()}


def test_running_quality_stream_equals_batch(spark, tmp_path):
    ev = _stream(spark, "events").select(F.col("user_id").alias("run"), (F.col("value") / 1000).alias("substring_recall"),
                                          (F.col("value") / 2000).alias("token_recall"))
    _run(live.to_memory(live.running_quality(ev, ["run"]), "t1_q", "complete", str(tmp_path / "c1")))
    got = {r.run: (r.num_examples, round(r.substring_recall, 9)) for r in spark.table("t1_q").collect()}
    b = spark.read.parquet(f"{SF_SMALL}/events.parquet").groupBy("user_id").agg(
        F.count("*").alias("n"), F.avg(F.col("value") / 1000).alias("m"))
    assert got == {r.user_id: (r.n, round(r.m, 9)) for r in b.collect()}


def test_windowed_peaks_stream_equals_batch(spark, tmp_path):
    ev = _stream(spark, "events").select("user_id", "ts", F.col("value").alias("cpu_ram_used_mb"))
    s = live.windowed_peaks(ev, ["user_id"], "ts", "1 hour", "1000 days")
    _run(live.to_memory(s, "t2_p", "complete", str(tmp_path / "c2")))
    got = {(r.window.start, r.user_id, r.cpu_ram_used_mb, r.n_samples) for r in spark.table("t2_p").collect()}
    bev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"),
                                                                  F.col("value").alias("cpu_ram_used_mb"))
    b = bev.groupBy(F.window("ts", "1 hour").alias("window"), "user_id").agg(
        F.max("cpu_ram_used_mb").alias("m"), F.count("*").alias("n"))
    want = {(r.window.start, r.user_id, r.m, r.n) for r in b.collect()}
    assert got == want


def test_windowed_peaks_append_emits_closed_windows(spark, tmp_path):
    """Append mode emits a window once the watermark passes its end. The
    files arrive out of time order, so rows older than the watermark are
    dropped: an emitted window can only have lost rows, never gained any."""
    ev = _stream(spark, "events").select("user_id", "ts", F.col("value").alias("cpu_ram_used_mb"))
    s = live.windowed_peaks(ev, ["user_id"], "ts", "1 hour", "1 hour")
    _run(live.to_memory(s, "t2_a", "append", str(tmp_path / "c2a")))
    got = {(r.window.start, r.user_id, r.cpu_ram_used_mb, r.n_samples) for r in spark.table("t2_a").collect()}
    bev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"),
                                                                  F.col("value").alias("cpu_ram_used_mb"))
    b = bev.groupBy(F.window("ts", "1 hour").alias("window"), "user_id").agg(
        F.max("cpu_ram_used_mb").alias("m"), F.count("*").alias("n"))
    want = {(r.window.start, r.user_id): (r.m, r.n) for r in b.collect()}
    assert got
    for start, user, m, n in got:
        bm, bn = want[(start, user)]
        assert n <= bn and m <= bm


def test_batch_progress_stream(spark, tmp_path):
    ev = _stream(spark, "events").withColumn("status", F.when(F.col("event_type") == "purchase", "completed")
                                             .otherwise("running"))
    out = {}

    def write(df, epoch):
        out["last"] = df.first()
    s = live.latest_status(ev, "user_id", "status", ["ts", "event_id"])
    q = (s.writeStream.outputMode("complete").foreachBatch(live.progress_sink(write))
         .option("checkpointLocation", str(tmp_path / "c3")).start())
    _run(q)
    bev = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumn(
        "status", F.when(F.col("event_type") == "purchase", "completed").otherwise("running"))
    b = agg.batch_rollup(agg.latest_status(bev, "user_id", "status", ["ts", "event_id"])).first()
    assert out["last"] == b


def test_live_quality_from_prediction_files(spark, tmp_path):
    """Prediction records in the K1 layout (JSON Lines partitioned by run),
    appended in two parts, read back as a stream and scored on arrival; the
    final state equals the batch A1."""
    from qaspark.operators.score import pair_next_turn, score
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    pairs = pair_next_turn(conv).select(
        (F.col("conv_id") % 3).cast("string").alias("run_id"),
        F.concat_ws(":", "conv_id", "turn").alias("question_id"), "question",
        F.array("question").alias("ground_truth"), F.col("prediction").alias("predicted_answer"))
    root = str(tmp_path / "out")
    for part in pairs.randomSplit([0.5, 0.5], seed=3):
        part.write.mode("append").partitionBy("run_id").json(f"{root}/predictions")
    q = live.to_memory(live.live_quality(live.predictions_stream(spark, f"{root}/predictions", 1)),
                       "t1_live", "complete", str(tmp_path / "c"))
    _run(q)
    got = {r.run_id: (r.num_examples, round(r.token_recall, 9), round(r.substring_recall, 9))
           for r in spark.table("t1_live").collect()}
    b = score(pairs, "predicted_answer", "ground_truth").groupBy("run_id").agg(
        F.count("*").alias("n"), F.avg("token_recall").alias("t"), F.avg("substring_recall").alias("s"))
    assert got == {r.run_id: (r.n, round(r.t, 9), round(r.s, 9)) for r in b.collect()}


def test_live_peaks_stream_equals_batch(spark, tmp_path):
    from qaspark.operators.telemetry import peak_telemetry

    def samples(df):
        return df.select("user_id", "ts", "event_id",
                         F.when(F.col("event_type") == "view", F.col("value")).alias("cpu_ram_used_mb"),
                         F.when(F.col("event_type") == "error", F.col("value")).alias("gpu_power_draw_w"),
                         F.when(F.col("event_type") == "error",
                                F.get_json_object("props", "$.k").cast("double")).alias("gpu_power_limit_w"))
    s = live.live_peaks(samples(_stream(spark, "events")), ["user_id"], ["ts", "event_id"])
    _run(live.to_memory(s, "t2_live", "complete", str(tmp_path / "c")))
    cols = ["user_id", "cpu_ram_used_mb", "gpu_power_draw_w", "gpu_power_limit_w", "n_samples"]
    got = {tuple(r) for r in spark.table("t2_live").select(*cols).collect()}
    b = peak_telemetry(samples(spark.read.parquet(f"{SF_SMALL}/events.parquet")), ["user_id"], ["ts", "event_id"])
    assert got == {tuple(r) for r in b.select(*cols).collect()}
