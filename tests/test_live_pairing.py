"""Live pairing of predictions and truths: stream = batch, late and missing truths, restarts."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from qaspark.streaming.pairing import live_quality, pair_in_time, quality_from_sums, quality_sink, quality_sums, scored_pairs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
P_SCHEMA = "run string, qid string, prediction string, at timestamp"
T_SCHEMA = "run string, qid string, truths array<string>, truth_at timestamp"
KEYS = ["run", "qid"]


def _at(minutes):
    return START + timedelta(minutes=minutes)


def _folders(tmp_path):
    return str(tmp_path / "p"), str(tmp_path / "t"), str(tmp_path / "check"), str(tmp_path / "sums")


def _land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _start(spark, p, t, check, sums):
    pairs = pair_in_time(spark.readStream.schema(P_SCHEMA).parquet(p), spark.readStream.schema(T_SCHEMA).parquet(t), KEYS, "at", "truth_at",
                         "10 minutes", "5 minutes")
    return scored_pairs(pairs, "prediction", "truths").writeStream.foreachBatch(quality_sink(sums, ["run"])).option("checkpointLocation", check).start()


def _advance(spark, q, p, t, minutes):
    """Rows of another run on both sides, whose times move the watermarks."""
    for i in range(2):
        _land(spark, p, [("clock", f"{minutes}-{i}", "", _at(minutes + i))], P_SCHEMA)
        _land(spark, t, [("clock", f"x{minutes}-{i}", [""], _at(minutes + i))], T_SCHEMA)
        q.processAllAvailable()


def _report(spark, sums):
    rows = live_quality(spark, sums, ["run"], "run string").filter("run <> 'clock'").collect()
    return {r["run"]: (round(r["substring_recall"], 9), round(r["token_recall"], 9), r["num_examples"], r["num_missing"]) for r in rows}


def test_stream_equals_batch_with_late_and_missing_truths(spark, tmp_path):
    p, t, check, sums = _folders(tmp_path)
    predictions = [("a", "1", "the red house", _at(0)), ("a", "2", "blue", _at(1)), ("a", "3", "no idea", _at(2)), ("b", "1", "green tree", _at(3)),
                   ("a", None, "nobody", _at(2))]
    in_time = [("a", "1", ["red house"], _at(4)), ("b", "1", ["green bush"], _at(1))]
    _land(spark, p, predictions, P_SCHEMA)
    _land(spark, t, in_time, T_SCHEMA)
    q = _start(spark, p, t, check, sums)
    q.processAllAvailable()
    assert _report(spark, sums) == {"a": (1.0, 1.0, 1, 0), "b": (0.5, 0.5, 1, 0)}
    _land(spark, t, [("a", "2", ["blue"], _at(9))], T_SCHEMA)                     # later, but within the wait
    q.processAllAvailable()
    assert _report(spark, sums)["a"] == (1.0, 1.0, 2, 0)
    _advance(spark, q, p, t, 60)                                                # the span of a-3 has passed
    assert _report(spark, sums)["a"] == (1.0, 1.0, 2, 2)                        # a-3 and the row without a key
    q.stop()
    q = _start(spark, p, t, check, sums)                                        # restart from the checkpoint
    _land(spark, t, [("a", "3", ["no"], _at(8))], T_SCHEMA)                      # far too late: no second row
    q.processAllAvailable()
    _advance(spark, q, p, t, 120)
    assert _report(spark, sums) == {"a": (1.0, 1.0, 2, 2), "b": (0.5, 0.5, 1, 0)}
    state = [s["numRowsTotal"] for s in q.lastProgress["stateOperators"]]
    assert sum(state) <= 8                                                      # settled rows have left the state
    q.stop()
    batch = pair_in_time(spark.createDataFrame(predictions, P_SCHEMA), spark.createDataFrame([*in_time, ("a", "2", ["blue"], _at(9))], T_SCHEMA),
                         KEYS, "at", "truth_at", "10 minutes")
    whole = quality_from_sums(quality_sums(scored_pairs(batch, "prediction", "truths"), ["run"]), ["run"]).collect()
    assert {r["run"]: (r["substring_recall"], r["token_recall"], r["num_examples"], r["num_missing"]) for r in whole} == _report(spark, sums)


def test_truth_outside_the_span_is_not_paired(spark):
    p = spark.createDataFrame([("a", "1", "x", _at(0)), ("a", "1", "x", _at(20)), ("a", "2", "x", None)], P_SCHEMA)
    t = spark.createDataFrame([("a", "1", ["x"], _at(11)), ("a", "2", ["x"], _at(0))], T_SCHEMA)
    got = pair_in_time(p, t, KEYS, "at", "truth_at", "10 minutes").select("qid", F.col("at").isNull().alias("no_time"), "paired").collect()
    assert sorted(tuple(r) for r in got) == [("1", False, False), ("1", False, True), ("2", True, False)]


def test_a_batch_that_runs_again_replaces_its_sums(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", "x", _at(0))], P_SCHEMA).withColumn("truths", F.array(F.lit("x"))).withColumn("paired", F.lit(True))
    scored = scored_pairs(rows, "prediction", "truths")
    fn = quality_sink(str(tmp_path / "sums"), ["run"])
    for epoch in (0, 0, 1, 1):
        fn(scored, epoch)
    assert _report(spark, str(tmp_path / "sums")) == {"a": (1.0, 1.0, 2, 0)}
