"""T1 + J3: live scoring when truths arrive apart from predictions.

Predictions and truths are two streams with event times and watermarks. A prediction is
paired with the truths of its key whose time lies within ``wait`` of its own; when the
watermarks have passed that span without one, the prediction comes out unpaired. So every
prediction leads to rows, state is kept for that span only, and a truth that arrives after
it has no effect. On tables the same functions give the batch result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import with_recalls

SUMS = "substring_sum double, token_sum double, num_examples long, num_missing long"


def pair_in_time(predictions: DataFrame, truths: DataFrame, keys: list[str], prediction_time: str, truth_time: str,
                 wait: str = "10 minutes", watermark: str = "5 minutes") -> DataFrame:
    """``predictions`` with the other columns of ``truths`` and ``paired``: left outer join
    on ``keys`` and times at most ``wait`` apart. Rows with a null key or time are paired
    with nothing; as a stream, rows later than the watermark are dropped. Both sides'
    other columns need different names."""
    p = predictions.withColumn(prediction_time, F.col(prediction_time).cast("timestamp")).withWatermark(prediction_time, watermark)
    t = truths.withColumn(truth_time, F.col(truth_time).cast("timestamp")).withWatermark(truth_time, watermark)
    t = t.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in t.columns if c not in keys], F.lit(True).alias("__paired"))
    span = F.expr(f"INTERVAL {wait}")
    on = F.col(truth_time).between(F.col(prediction_time) - span, F.col(prediction_time) + span)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    out = p.join(t, on, "left_outer").withColumn("paired", F.coalesce("__paired", F.lit(False)))
    return out.drop("__paired", *[f"__{k}" for k in keys])


def scored_pairs(pairs: DataFrame, prediction: str, truths: str) -> DataFrame:
    """Both recalls of every paired row; null for an unpaired one."""
    s = with_recalls(pairs, prediction, truths)
    return (s.withColumn("substring_recall", F.when(F.col("paired"), F.col("substring_recall")))
            .withColumn("token_recall", F.when(F.col("paired"), F.col("token_recall"))))


def quality_sums(scored: DataFrame, run_cols: list[str]) -> DataFrame:
    """Per run the sums of both recalls, the paired rows and the unpaired ones."""
    return scored.groupBy(*run_cols).agg(
        F.coalesce(F.sum("substring_recall"), F.lit(0.0)).alias("substring_sum"), F.coalesce(F.sum("token_recall"), F.lit(0.0)).alias("token_sum"),
        F.count_if("paired").alias("num_examples"), F.count_if(~F.col("paired")).alias("num_missing"))


def quality_from_sums(sums: DataFrame, run_cols: list[str]) -> DataFrame:
    """Means per run; 0.0 for a run whose predictions all miss their truth."""
    n = F.sum("num_examples")
    return sums.groupBy(*run_cols).agg(
        F.coalesce(F.try_divide(F.sum("substring_sum"), n), F.lit(0.0)).alias("substring_recall"),
        F.coalesce(F.try_divide(F.sum("token_sum"), n), F.lit(0.0)).alias("token_recall"),
        n.alias("num_examples"), F.sum("num_missing").alias("num_missing"))


def quality_sink(path: str, run_cols: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the sums of each micro-batch of
    :func:`scored_pairs` under its number; a batch that runs again replaces its own."""
    def fn(batch: DataFrame, epoch_id: int) -> None:
        quality_sums(batch, run_cols).write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch_id}")
    return fn


def live_quality(spark: SparkSession, path: str, run_cols: list[str], run_schema: str) -> DataFrame:
    """T1 so far, from the sums kept by :func:`quality_sink`: means per run, paired rows
    and predictions whose truth did not come in time."""
    sums = spark.read.schema(f"{run_schema}, {SUMS}").option("basePath", path).parquet(f"{path.rstrip('/')}/epoch=*")
    return quality_from_sums(sums, run_cols)

