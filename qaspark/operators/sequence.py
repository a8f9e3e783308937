"""Window / sequence operators (W1-W6) that survive one run holding a large
share of all rows.

A plain ``Window.partitionBy(run)`` puts a whole run into one task. The running
operators here follow one path at every size:

1. rows are range-partitioned by ``(run, order...)``, so a large run spreads over
   many neighbouring partitions; the number of a row's partition is its *block*.
   The blocked rows are checkpointed, so every later branch and every retry sees
   the same blocks;
2. local running values use ``Window.partitionBy(run, block)``;
3. per ``(run, block)`` totals (a partial aggregate: #runs + #blocks rows) get
   exclusive prefix sums per run, joined back on ``(run, block)``.

The run is compared as a struct, in which nulls equal nulls: rows with a null run
key form a run like any other. A running sum is null until the run's first value.
Row counts per run come from the same totals, so no join on the bare run key (a
hot key) is ever needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_RUN, _BLOCK = "__run", "__block"


def assign_blocks(df: DataFrame, run_cols: list[str], order_cols: list[str],
                  n_blocks: int | None = None) -> DataFrame:
    """Add ``__run`` (the run columns as a struct) and ``__block``: contiguous ranges
    of ``(run, order)``, as many as shuffle partitions (or ``n_blocks``)."""
    n = n_blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *run_cols, *order_cols)
    return materialize(ranged.withColumn(_RUN, F.struct(*run_cols)).withColumn(_BLOCK, F.spark_partition_id()))


def running_stats(df: DataFrame, run_cols: list[str], order_cols: list[str],
                  value_cols: list[str] | None = None, n_blocks: int | None = None) -> DataFrame:
    """Add ``position`` (1-based, in ``order_cols`` within the run),
    ``run_count`` (rows in the run) and ``running_sum_<v>`` for each value
    column (sum over the non-null values up to and including this row, null
    while there is none).

    ``order_cols`` must make the order within a run total (unique keys). Block
    totals come from a partial aggregation of the blocked rows, so their shuffle
    is tiny; only the per-block offset table is joined back.
    """
    value_cols = value_cols or []
    blocked = assign_blocks(df, run_cols, order_cols, n_blocks)
    w_local = (Window.partitionBy(_RUN, _BLOCK).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = blocked.select("*", F.count(F.lit(1)).over(w_local).alias("__lpos"),
                           *[F.sum(F.col(v)).over(w_local).alias(f"__lsum_{v}") for v in value_cols])
    totals = blocked.groupBy(_RUN, _BLOCK).agg(
        F.count(F.lit(1)).alias("__bcnt"),
        *[F.sum(F.col(v)).alias(f"__bsum_{v}") for v in value_cols])
    w_prev = Window.partitionBy(_RUN).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _RUN, _BLOCK,
        F.coalesce(F.sum("__bcnt").over(w_prev), F.lit(0)).alias("__ocnt"),
        F.sum("__bcnt").over(Window.partitionBy(_RUN)).alias("__n"),
        *[F.sum(f"__bsum_{v}").over(w_prev).alias(f"__osum_{v}") for v in value_cols])
    out = local.join(offsets, [_RUN, _BLOCK])
    sums = [F.when(F.col(f"__osum_{v}").isNull(), F.col(f"__lsum_{v}"))
             .otherwise(F.col(f"__osum_{v}") + F.coalesce(f"__lsum_{v}", F.lit(0))).alias(f"running_sum_{v}")
            for v in value_cols]
    return out.select(*df.columns, (F.col("__ocnt") + F.col("__lpos")).cast("bigint").alias("position"),
                      F.col("__n").cast("bigint").alias("run_count"), *sums)


def running_mean(df: DataFrame, run_cols: list[str], order_cols: list[str], value: str,
                 out: str = "running_mean", n_blocks: int | None = None) -> DataFrame:
    """Mean of ``value`` over the run's rows up to the current one."""
    r = running_stats(df, run_cols, order_cols, [value], n_blocks)      # a null value counts as a row without a value
    return (r.withColumn(out, F.col(f"running_sum_{value}") / F.col("position"))
             .drop(f"running_sum_{value}"))


def progress_rows(df: DataFrame, run_cols: list[str], order_cols: list[str], value: str,
                  every: int = 10, report_every: int = 100,
                  n_blocks: int | None = None) -> DataFrame:
    """Running mean at the progress rows (position 1 or a multiple of
    ``every``), the percentage of the run processed, and a flag for the
    telemetry report rows (multiples of ``report_every``)."""
    r = running_mean(df, run_cols, order_cols, value, "running_mean", n_blocks)
    r = r.withColumn("progress_pct", F.when(F.col("run_count") > 0,
                                            F.col("position") * 100.0 / F.col("run_count")).otherwise(0.0))
    r = r.withColumn("is_report", (F.col("position") % report_every) == 0)
    return r.filter((F.col("position") == 1) | ((F.col("position") % every) == 0))


def scalar_series(df: DataFrame, run_cols: list[str], order_cols: list[str], series_cols: list[str],
                  title: str, zero_based: bool = True, n_blocks: int | None = None) -> DataFrame:
    """Long scalar series ``(run…, title, series, iteration, value)``;
    one row per item and series column, iteration in item order."""
    r = running_stats(df.select(*run_cols, *order_cols, *series_cols), run_cols, order_cols, [], n_blocks)
    it = (F.col("position") - 1) if zero_based else F.col("position")
    r = r.withColumn("iteration", it.cast("bigint"))
    stacked = r.select(*run_cols, "iteration",
                       *[F.col(c).cast("double").alias(c) for c in series_cols])
    long = stacked.unpivot([*run_cols, "iteration"], series_cols, "series", "value")
    return long.select(*run_cols, F.lit(title).alias("title"), "series", "iteration", "value")


def first_n(df: DataFrame, run_cols: list[str], order_cols: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of every run plus the run's total and the
    "``k`` more" count.

    The ``row_number() <= n`` filter becomes a WindowGroupLimit, which also
    runs *before* the shuffle, so a hot run ships at most ``n`` rows per map
    task. Totals are a partial aggregation.
    """
    w = Window.partitionBy(*run_cols).orderBy(*order_cols)
    head = df.withColumn("position", F.row_number().over(w).cast("bigint")).filter(F.col("position") <= n)
    totals = df.groupBy(*run_cols).agg(F.count(F.lit(1)).alias("run_count")).select(F.struct(*run_cols).alias(_RUN), "run_count")
    return (head.withColumn(_RUN, F.struct(*run_cols)).join(totals, _RUN).drop(_RUN)      # null runs are runs too
                .withColumn("n_more", F.greatest(F.col("run_count") - F.lit(n), F.lit(0)).cast("bigint")))


def previews(preds: DataFrame, run_cols: list[str], order_cols: list[str], n_predictions: int = 100,
             n_prompts: int = 20, prompt_col: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """The first ``n_predictions`` predictions and the first ``n_prompts``
    predictions that carry a prompt, per run, each with the run total and the
    "``k`` more" count."""
    return (first_n(preds, run_cols, order_cols, n_predictions),
            first_n(preds.filter(F.col(prompt_col).isNotNull()), run_cols, order_cols, n_prompts))
