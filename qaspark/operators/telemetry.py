"""Telemetry peaks and utilisation.

Peak rules: each memory measure peaks at its max with null read as 0; power
draw ignores null/0 samples; power limit is the last non-zero sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMORY_MEASURES = ("cpu_ram_used_mb", "gpu_ram_used_mb", "gpu_ram_peak_mb", "reserved_gpu_ram_mb")
BUSY_PCT = 5.0          # a GPU counts as busy above this usage
POWER_WARN = 0.9        # draw / limit above this warns


def peak_telemetry(samples: DataFrame, run_cols: list[str], order_cols: list[str],
                   measures=MEMORY_MEASURES, draw: str = "gpu_power_draw_w",
                   limit: str = "gpu_power_limit_w", duration_ts: str | None = None) -> DataFrame:
    """A4: one row of peaks per run (partial aggregation, hot runs pre-reduced).

    ``duration_ts`` also returns ``duration_seconds`` -- last minus first
    sample time -- from the same aggregation (A5), so the samples are read and
    shuffled once."""
    o = F.struct(*order_cols)
    have = set(samples.columns)
    # a measure without a column has no samples: its peak is 0 (null reads as 0)
    aggs = [(F.max(F.coalesce(F.col(m), F.lit(0.0))) if m in have else F.lit(0.0)).alias(m) for m in measures]
    if draw in have:
        d = F.col(draw)
        aggs.append(F.coalesce(F.max(F.when(d != 0, d)), F.lit(0.0)).alias(draw))
    else:
        aggs.append(F.lit(0.0).alias(draw))
    if limit in have:
        lim = F.col(limit)
        aggs.append(F.coalesce(F.max_by(F.when(lim != 0, lim), F.when(lim != 0, o)), F.lit(0.0)).alias(limit))
    else:
        aggs.append(F.lit(0.0).alias(limit))
    aggs.append(F.count(F.lit(1)).cast("bigint").alias("n_samples"))
    if duration_ts:
        # microseconds between the first and last sample; time-zone independent for NTZ input
        aggs.append((F.timestamp_diff("MICROSECOND", F.min(duration_ts), F.max(duration_ts)) / F.lit(1e6))
                    .alias("duration_seconds"))
    return samples.groupBy(*run_cols).agg(*aggs)


def power_utilisation_pct(draw, limit) -> Column:
    """Draw / limit × 100, 0 when the limit is 0 or null."""
    d = F.col(draw) if isinstance(draw, str) else draw
    lim = F.col(limit) if isinstance(limit, str) else limit
    return F.coalesce(F.try_divide(d * F.lit(100.0), F.when(lim != 0, lim)), F.lit(0.0))


def gpu_utilisation(df: DataFrame, total_gb: str = "total_gb", free_gb: str = "free_gb") -> DataFrame:
    """A10: used = total − free, usage % (0 when total is 0), busy above 5 %."""
    used = F.col(total_gb) - F.col(free_gb)
    pct = F.coalesce(F.try_divide(used * F.lit(100.0), F.when(F.col(total_gb) != 0, F.col(total_gb))), F.lit(0.0))
    return (df.withColumn("used_gb", used).withColumn("usage_pct", pct)
              .withColumn("busy", F.col("usage_pct") > F.lit(BUSY_PCT)))


def gpu_series(df: DataFrame, gpu_col: str, ts_col: str, window: str = "1 minute") -> DataFrame:
    """A10 series: per GPU and time window, mean/max usage, mean/max used GB,
    and the busy and total sample counts (one partial aggregation)."""
    return (gpu_utilisation(df).groupBy(gpu_col, F.window(ts_col, window).alias("window"))
            .agg(F.avg("usage_pct").alias("avg_usage_pct"), F.max("usage_pct").alias("max_usage_pct"),
                 F.avg("used_gb").alias("avg_used_gb"), F.max("used_gb").alias("max_used_gb"),
                 F.count_if("busy").cast("bigint").alias("busy_samples"),
                 F.count(F.lit(1)).cast("bigint").alias("n_samples")))
