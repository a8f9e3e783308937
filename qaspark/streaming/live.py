"""Structured Streaming versions of the live reports.

The report functions take a *streaming* DataFrame and return the streaming
aggregate; state is one row per key (T1, T3, T4, T2 so far) or per key and
time window (windowed T2, bounded by the watermark). The same built-in
aggregates as the batch operators are used, so a stream over the same rows
ends with the batch result. ``predictions_stream`` opens the K1 folder as a
stream; ``to_memory`` starts a query into an in-memory table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import aggregate as agg
from ..operators.score import score
from ..operators.telemetry import MEMORY_MEASURES, peak_telemetry

PREDICTION_FILE_SCHEMA = ("run_id string, question_id string, question string, ground_truth array<string>, "
                          "predicted_answer string")


def running_quality(scored: DataFrame, run_cols: list[str]) -> DataFrame:
    """Mean substring / token recall and count so far per run (update mode)."""
    return scored.groupBy(*run_cols).agg(
        F.avg("substring_recall").alias("substring_recall"),
        F.avg("token_recall").alias("token_recall"),
        F.count(F.lit(1)).cast("bigint").alias("num_examples"))


def predictions_stream(spark, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Prediction records (K1 JSON Lines under ``path``, partitioned by run)
    as they arrive."""
    r = spark.readStream.schema(PREDICTION_FILE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def live_quality(predictions: DataFrame, run_cols: list[str] | None = None) -> DataFrame:
    """T1 from prediction records: each arriving record is scored with the
    same built-in recall expressions as the batch path, then the running
    means per run are kept (state: one row per run)."""
    return running_quality(score(predictions, "predicted_answer", "ground_truth"), run_cols or ["run_id"])


def live_peaks(samples: DataFrame, run_cols: list[str], order_cols: list[str]) -> DataFrame:
    """T2 (so far): the A4 peaks per run over every sample seen so far --
    the batch aggregate as a streaming one (update or complete mode; state is
    one row per run)."""
    return peak_telemetry(samples, run_cols, order_cols)


def windowed_peaks(samples: DataFrame, run_cols: list[str], ts_col: str, window: str = "1 hour",
                   watermark: str = "10 minutes", measures=MEMORY_MEASURES,
                   draw: str = "gpu_power_draw_w") -> DataFrame:
    """Telemetry peaks per run and event-time window; rows later than the
    watermark are dropped. ``TIMESTAMP_NTZ`` input is cast to TIMESTAMP (the
    watermark needs it)."""
    s = samples.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    aggs = [F.max(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in measures if m in samples.columns]
    if draw in samples.columns:
        aggs.append(F.coalesce(F.max(F.when(F.col(draw) != 0, F.col(draw))), F.lit(0.0)).alias(draw))
    aggs.append(F.count(F.lit(1)).cast("bigint").alias("n_samples"))
    return s.groupBy(F.window(ts_col, window).alias("window"), *run_cols).agg(*aggs)


def latest_status(events: DataFrame, task_col: str, status_col: str, order_cols: list[str]) -> DataFrame:
    """T3 (state part): latest status per task (complete or update mode)."""
    return agg.latest_status(events, task_col, status_col, order_cols)


def progress_sink(write_rollup: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """T3 (report part): a ``foreachBatch`` function that turns the complete
    latest-status table of each micro-batch into the roll-up counts."""
    def fn(batch: DataFrame, epoch_id: int) -> None:
        write_rollup(agg.batch_rollup(batch), epoch_id)
    return fn


def latest_values(events: DataFrame, key_cols: list[str], value_col: str, order_cols: list[str]) -> DataFrame:
    """T4: last write wins per key, as a streaming aggregate."""
    return agg.latest_value(events, key_cols, value_col, order_cols)


def to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Start ``stream`` into an in-memory table (tests / notebooks)."""
    return (stream.writeStream.format("memory").queryName(name).outputMode(mode)
            .option("checkpointLocation", checkpoint).start())
