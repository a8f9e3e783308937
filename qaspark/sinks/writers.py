"""Sinks (K1-K11): every report is a DataFrame written by Spark's own
writers, partitioned by run so reruns replace only their own folder.

All writers take an output root (any Hadoop path: local, HDFS, ``s3a://``)
and return the path written. JSON output is JSON Lines, one record per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import file_stem
from ..functions.text import SERIES_REPLACED, sanitize_series

# ---- fixed values ----------------------------------------------------------
FORMAT_VERSION = "1.0"           # K9: format version written with the run metadata
# ---------------------------------------------------------------------------


def _by_run(df: DataFrame, path: str, run_col: str, fmt: str, *more_parts: str, **options) -> str:
    """Write ``df`` below ``path``, one folder per run: a rerun replaces the folders of its
    own runs and no others. Rows are rebalanced by run first, so a small run is one file
    and a large one is split."""
    parts = [run_col, *more_parts]
    (df.hint("rebalance", *[F.col(c) for c in parts]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .options(**options).partitionBy(*parts).format(fmt).save(path))
    return path


def run_metadata(df: DataFrame, name: Column | str, at: Column | None = None) -> DataFrame:
    """K9: ``experiment_name`` (a column, or a constant text), ``timestamp`` and
    ``format_version`` on every record; ``at`` is the write time unless given."""
    name = F.lit(name) if isinstance(name, str) else name
    return df.select("*", name.alias("experiment_name"), (F.current_timestamp() if at is None else at).alias("timestamp"),
                     F.lit(FORMAT_VERSION).alias("format_version"))


def prediction_records(preds: DataFrame, run_col: str = "run_id") -> DataFrame:
    """K1: ``question_id, question, ground_truth, predicted_answer`` of each run."""
    return preds.select(run_col, "question_id", "question", "ground_truth", "predicted_answer")


def write_predictions(preds: DataFrame, root: str, run_col: str = "run_id", fmt: str = "json") -> str:
    """K1: prediction records per run."""
    return _by_run(prediction_records(preds, run_col), f"{root}/predictions", run_col, fmt)


def metric_records(metrics: DataFrame, run_col: str = "run_id", at: Column | None = None) -> DataFrame:
    """K2: the metrics of each run with its run metadata (named after the run)."""
    return run_metadata(metrics, F.col(run_col).cast("string"), at)


def write_run_metrics(metrics: DataFrame, root: str, run_col: str = "run_id", fmt: str = "json") -> str:
    """K2: one metrics record per run; a rerun replaces it."""
    return _by_run(metric_records(metrics, run_col), f"{root}/metrics", run_col, fmt)


def config_records(configs: DataFrame, run_col: str = "run_id", config_cols: list[str] | None = None) -> DataFrame:
    """K3: the resolved config of each run as one JSON text column."""
    cols = config_cols or [c for c in configs.columns if c != run_col]
    return configs.select(run_col, F.to_json(F.struct(*cols)).alias("config"))


def write_run_config(configs: DataFrame, root: str, run_col: str = "run_id",
                     config_cols: list[str] | None = None) -> str:
    """K3: one config record per run; a rerun replaces it."""
    return _by_run(config_records(configs, run_col, config_cols), f"{root}/config", run_col, "json")


def write_telemetry(samples: DataFrame, peaks: DataFrame, root: str, run_col: str = "run_id") -> tuple[str, str]:
    """K4: telemetry samples and per-run peaks as two tables, both replaced by a rerun."""
    return (_by_run(samples, f"{root}/telemetry/samples", run_col, "parquet"),
            _by_run(peaks, f"{root}/telemetry/peaks", run_col, "parquet"))


def single_value_records(values: DataFrame, key_cols: list[str], value_col: str = "value",
                         order_cols: tuple[str, ...] = ("ts",), run_col: str = "run_id") -> DataFrame:
    """K6: single values of each run -- last write wins per key."""
    from ..operators.aggregate import latest_value
    return latest_value(values, [run_col, *key_cols], value_col, list(order_cols))


def write_single_values(values: DataFrame, root: str, key_cols: list[str], value_col: str = "value",
                        order_cols: tuple[str, ...] = ("ts",), run_col: str = "run_id") -> str:
    """K6: single values per run as JSON."""
    return _by_run(single_value_records(values, key_cols, value_col, order_cols, run_col), f"{root}/single_values", run_col, "json")


def series_records(series: DataFrame) -> DataFrame:
    """K5: scalar series with '/' and spaces in title and series name replaced by '_'."""
    return (series.withColumn("title", sanitize_series(F.col("title")))
                  .withColumn("series", sanitize_series(F.col("series"))))


def write_series(series: DataFrame, root: str, with_json: bool = True, run_col: str = "run_id") -> str:
    """K5: scalar series, one CSV folder per (run, title, series), and all series of a run
    as JSON Lines under their own names."""
    if with_json:
        _by_run(series, f"{root}/series_json", run_col, "json")
    return _by_run(series_records(series), f"{root}/series", run_col, "csv", "title", "series", header=True)


def table_records(df: DataFrame, title: str, series: str = "", iteration: int = 0, run_col: str = "run_id",
                  at: Column | None = None) -> DataFrame:
    """K7: one record per logged table of a run: title, series, iteration, its columns and
    row count, and the time; the rows themselves are the table."""
    columns = [c for c in df.columns if c != run_col]
    return df.groupBy(run_col).agg(F.count(F.lit(1)).alias("n_rows")).select(
        run_col, F.lit(title).alias("title"), F.lit(series).alias("series"), F.lit(iteration).cast("bigint").alias("iteration"),
        F.array(*[F.lit(c) for c in columns]).alias("columns"), "n_rows", (F.current_timestamp() if at is None else at).alias("timestamp"))


def write_table(df: DataFrame, root: str, title: str, fmt: str = "parquet", series: str = "", iteration: int = 0,
                run_col: str = "run_id") -> str:
    """K7: a logged table under its (sanitised) title, per run, and its record beside it."""
    stem = "/".join(series_stem(x) for x in (title, series) if x) + f"/{iteration}"
    _by_run(table_records(df, title, series, iteration, run_col), f"{root}/table_records/{stem}", run_col, "json")
    return _by_run(df, f"{root}/tables/{stem}", run_col, fmt)


def write_text_log(lines: DataFrame, root: str) -> str:
    """K8: append text-log lines ``(run_id, ts, text)``."""
    lines.write.mode("append").parquet(f"{root}/log")
    return f"{root}/log"


def artifact_metadata(**values) -> Column:
    """The metadata of an artifact as JSON text: constants or columns by name."""
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()]))


def manifest_rows(df: DataFrame, name_col: str, path_col: str, saved_col: str, at: Column | None = None) -> DataFrame:
    """Artifact manifest rows (name, original and saved path, timestamp
    plus any extra columns present in ``df``)."""
    extra = [c for c in df.columns if c not in (name_col, path_col, saved_col)]
    return df.select(F.col(name_col).alias("name"), F.col(path_col).alias("original_path"), F.col(saved_col).alias("saved_path"),
                     (F.current_timestamp() if at is None else at).alias("timestamp"), *extra)


def append_manifest(rows: DataFrame, root: str, run_col: str | None = None) -> str:
    """Add to the manifest table; with a run column a rerun replaces its own rows."""
    if run_col:
        return _by_run(rows, f"{root}/artifacts", run_col, "parquet")
    rows.write.mode("append").parquet(f"{root}/artifacts")
    return f"{root}/artifacts"


def series_stem(name: str) -> str:
    """The replacement rule of :func:`qaspark.functions.text.sanitize_series` for one constant name."""
    for c in SERIES_REPLACED:
        name = name.replace(c, "_")
    return name


def object_result_path(scheme: str, bucket: str, run: str, kind: str) -> str:
    """K11 (driver-side string for one run):
    ``{scheme}://{bucket}/{run}/experiment_results/{stem}_{kind}.json``."""
    stem = run.replace("/", "_").replace("\\", "_")
    return f"{scheme}://{bucket}/{run}/experiment_results/{stem}_{kind}.json"


__all__ = ["append_manifest", "artifact_metadata", "config_records", "file_stem", "manifest_rows", "metric_records",
           "object_result_path", "prediction_records", "run_metadata", "series_records", "single_value_records",
           "table_records", "write_predictions", "write_run_config", "write_run_metrics", "write_series",
           "write_single_values", "write_table", "write_telemetry", "write_text_log"]
