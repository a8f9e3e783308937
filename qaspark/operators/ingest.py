"""Item preparation (P1, P4, P5, P6, A7): drop items without a question,
keep scorable ones, cap per run in file order, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .score import resolve_truth


def filter_has_question(items: DataFrame) -> DataFrame:
    """A missing or empty question drops the item; whitespace-only
    questions are kept."""
    return items.filter(F.col("question").isNotNull() & (F.col("question") != ""))


def filter_scorable(items: DataFrame) -> DataFrame:
    """Items with a null or empty answer list are not scored."""
    return items.filter(F.coalesce(F.size("answer") > 0, F.lit(False)))


def with_truths(items: DataFrame) -> DataFrame:
    """``truths`` = ``metadata.all_answers`` if non-empty, else ``answer``."""
    return items.withColumn("truths", resolve_truth(F.col("metadata.all_answers"), F.col("answer")))


def cap_samples(items: DataFrame, n: int | None, run_cols: list[str] | None = None,
                order_col: str = "ordinal") -> DataFrame:
    """P5: the first ``n`` items in file order (globally or per run); 0 or
    None mean no cap. Planned as TakeOrderedAndProject / WindowGroupLimit, so
    only ``n`` rows per task cross the shuffle."""
    if not n:
        return items
    if not run_cols:
        return items.orderBy(order_col).limit(n)
    w = Window.partitionBy(*run_cols).orderBy(order_col)
    return items.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def prepare_items(items: DataFrame, max_samples: int | None = None,
                  run_cols: list[str] | None = None) -> DataFrame:
    """P1 → P4 → P5 → P6: the items a run scores."""
    return with_truths(cap_samples(filter_scorable(filter_has_question(items)), max_samples, run_cols))


def dataset_stats(items: DataFrame, max_samples: int | None = None,
                  run_cols: list[str] | None = None) -> DataFrame:
    """``eval_size`` (all records, including those dropped later), valid
    (question present and scorable) and to-process (valid under the cap)."""
    run_cols = run_cols or []
    valid = (F.col("question").isNotNull() & (F.col("question") != "")
             & F.coalesce(F.size("answer") > 0, F.lit(False)))
    g = items.groupBy(*run_cols) if run_cols else items.groupBy()
    s = g.agg(F.count(F.lit(1)).cast("bigint").alias("eval_size"),
              F.count_if(valid).cast("bigint").alias("valid_count"))
    to_proc = F.least(F.col("valid_count"), F.lit(max_samples).cast("bigint")) if max_samples else F.col("valid_count")
    return s.withColumn("to_process", to_proc)
