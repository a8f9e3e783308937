"""Run grid (J1, J2, O1, O2): every model × every dataset for one mode, with
the memory estimate looked up per model.

The grid is by definition the product of two *configuration* dimensions: every
model is run on every dataset. It is the one place where a product is the feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import DEFAULT_MEMORY_GB, bucket_name, output_dir, run_name, task_id

def run_grid(models: DataFrame, datasets: DataFrame, mode: str,
             model_cols=("model", "model_stem"), dataset_cols=("dataset", "dataset_stem")) -> DataFrame:
    """J1 + P8/P9/P11: one row per (model, dataset) with run name, task id,
    output folder and bucket."""
    m_name, m_stem = model_cols
    d_name, d_stem = dataset_cols
    g = (models.select(F.col(m_name).alias("model"), F.col(m_stem).alias("model_stem"))
         .crossJoin(datasets.select(F.col(d_name).cast("string").alias("dataset"), F.col(d_stem).cast("string").alias("dataset_stem")))
         .withColumn("experiment_mode", F.lit(mode)))
    name = run_name("model", "dataset", "experiment_mode")
    return (g.withColumn("run_name", name)
             .withColumn("task_id", task_id("model_stem", "dataset_stem", "experiment_mode"))
             .withColumn("output_dir", output_dir("experiment_mode", name))
             .withColumn("bucket", bucket_name("experiment_mode")))


def with_memory_estimate(grid: DataFrame, estimates: DataFrame, key: str = "model",
                         est_col: str = "estimated_memory_gb") -> DataFrame:
    """Left lookup of the per-model estimate; a miss gets the default.

    ``estimates`` has one row per model, so the join never multiplies rows;
    Catalyst/AQE pick broadcast when its measured size allows it.
    """
    e = estimates.select(F.col(key).alias("__k"), F.col(est_col).alias("__e"))
    j = grid.join(e, grid[key] == e["__k"], "left")
    return j.withColumn(est_col, F.coalesce("__e", F.lit(DEFAULT_MEMORY_GB))).drop("__k", "__e")


def order_by_memory(grid: DataFrame, est_col: str = "estimated_memory_gb",
                    tie_cols=("model", "dataset")) -> DataFrame:
    """O1: listing by estimate ascending, stable on the given columns."""
    return grid.orderBy(F.col(est_col).asc(), *[F.col(c).asc() for c in tie_cols])
