"""Run naming, storage paths, model-size parsing and unit conversion
(P8-P12, K11, F19, F20) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws

# ---- fixed values ----------------------------------------------------------
GB_PER_BILLION_PARAMS = 2.5          # memory planning factor (fp16 + headroom)
DEFAULT_MEMORY_GB = 3.0              # estimate for a model with no usable size
# Fallback estimates when the size text is not a number, first match wins:
#   size text contains "0.6" or model name contains "135m" → 2.0
#   size text contains "1.7" or model name contains "360m" → 4.0
#   size text contains "4"                                 → 9.0
#   otherwise                                              → 3.0
BYTES_PER_MB = 1048576.0
MB_PER_GB = 1024.0
RESULTS_DIR = "experiment_results"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def run_name(model, dataset, mode) -> Column:
    """``{model}_{dataset}_{mode}``."""
    return F.concat_ws("_", _c(model), _c(dataset), _c(mode))


def output_dir(mode, name) -> Column:
    """``{mode}/{run name}`` (also the project name is the mode)."""
    return F.concat_ws("/", _c(mode), _c(name))


def task_id(model_stem, dataset_stem, mode) -> Column:
    """Grid task id from config file stems (not config names)."""
    return F.concat_ws("_", _c(model_stem), _c(dataset_stem), _c(mode))


def file_stem(name) -> Column:
    """P10: file-safe stem -- '/' and '\\' become '_'."""
    return F.translate(_c(name), "/\\", "__")


def bucket_name(mode) -> Column:
    """Bucket per mode -- '_' becomes '-', lower case."""
    return F.lower(F.replace(_c(mode), F.lit("_"), F.lit("-")))


def split_object_path(path) -> tuple[Column, Column]:
    """``s3://bucket/key`` → (bucket, key)."""
    p = _c(path)
    return (F.regexp_extract(p, r"^[a-zA-Z0-9]+://([^/]*)", 1),
            F.regexp_extract(p, r"^[a-zA-Z0-9]+://[^/]*/(.*)$", 1))


def results_path(scheme: str, bucket, run, kind) -> Column:
    """``{scheme}://{bucket}/{run}/experiment_results/{stem(run)}_{kind}.json``."""
    return F.concat(F.lit(f"{scheme}://"), _c(bucket), F.lit("/"), _c(run), F.lit(f"/{RESULTS_DIR}/"),
                    file_stem(_c(run)), F.lit("_"), _c(kind), F.lit(".json"))


def memory_estimate_gb(model_size, model_name) -> Column:
    """size text like ``1.7B`` → billions × 2.5 GB; text that is not a
    number falls back by substring rules (see fixed values above)."""
    s = strip_ws(F.replace(_c(model_size), F.lit("B"), F.lit("")))
    num = s.try_cast("double")
    name = F.lower(_c(model_name))
    fallback = (F.when(s.contains("0.6") | name.contains("135m"), F.lit(2.0))
                 .when(s.contains("1.7") | name.contains("360m"), F.lit(4.0))
                 .when(s.contains("4"), F.lit(9.0))
                 .otherwise(F.lit(DEFAULT_MEMORY_GB)))
    return F.when(num.isNotNull(), num * F.lit(GB_PER_BILLION_PARAMS)).otherwise(fallback)


def bytes_to_mb(c) -> Column:
    """F20."""
    return _c(c).cast("double") / F.lit(BYTES_PER_MB)


def mb_to_gb(c) -> Column:
    """F20 / S9."""
    return _c(c).cast("double") / F.lit(MB_PER_GB)
