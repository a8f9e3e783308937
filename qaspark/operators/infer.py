"""Inference hook.

The user supplies a *batch* function ``generate(prompts: pandas.Series) ->
pandas.Series`` (for example a model loaded once per task). We run it with
``mapInArrow`` over batches of already rendered prompts (only the prompt column
becomes pandas, all others stay Arrow); everything
around it (prompt rendering before, answer cleaning and scoring after) stays
built-in column expressions.

A batch that raises is retried one row at a time so that only the failing
rows get the error sentinel (U5). The output should be materialised
(:func:`qaspark.session.materialize`) before two consumers read it, so the
model never runs twice -- also not after an executor loss.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import GEN_ERROR, clean_answer
from ..session import materialize
from ..shipping import ship

CONSTANT_ANSWER = "Test answer"   # U2: the constant model's answer
CONSTANT_MODEL_BYTES = 1024       # U2: its reported size


TELEMETRY_FIELDS = [T.StructField("gen_end_ts", T.DoubleType()), T.StructField("gen_seconds", T.DoubleType()),
                    T.StructField("worker_peak_rss_mb", T.DoubleType())]


def _worker_peak_rss_mb() -> float:
    try:
        import resource
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024.0   # KiB on Linux
    except (ImportError, OSError):
        return 0.0


def infer(df: DataFrame, generate: Callable[[pd.Series], pd.Series] | None = None, prompt_col: str = "prompt",
          out_col: str = "raw_answer", error_col: str = "error",
          factory: Callable[[], Callable[[pd.Series], pd.Series]] | None = None,
          telemetry: bool = False) -> DataFrame:
    """U1 + U5: add ``out_col`` (generated text) and ``error_col`` (message or
    null) to every row of ``df``. Filter and cap *before* calling this:
    Catalyst cannot push predicates through ``mapInArrow``.

    Pass either ``generate`` (a light batch function shipped with the task)
    or ``factory`` (called once per task on the executor to build the batch
    function -- load a model there, not on the driver).

    ``telemetry`` adds, per row, the end time of its batch (epoch seconds),
    the batch's generation seconds and the Python worker's peak RSS in MB --
    the samples the run record's duration and memory peak are built from."""
    if (generate is None) == (factory is None):
        raise ValueError("pass exactly one of generate / factory")
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType()),
                                              T.StructField(error_col, T.StringType())]
                          + (TELEMETRY_FIELDS if telemetry else []))

    def run(it):
        fn = generate if generate is not None else factory()
        for batch in it:
            yield _answered(batch, *_generate(fn, batch.column(prompt_col).to_pandas()), out_col, error_col, telemetry)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def _generate(fn: Callable | None, prompts: pd.Series) -> tuple[list, list, float, float]:
    """Answers and errors of one slice, its end time and its seconds; a failing batch is
    repeated row by row, and ``None`` is the constant model."""
    started = time.time()
    errors: list = [None] * len(prompts)
    if fn is None:
        answers_ = [CONSTANT_ANSWER] * len(prompts)
    else:
        try:
            answers_ = list(fn(prompts))
        except Exception:  # noqa: BLE001 -- retry per row, keep the run going
            answers_ = []
            for i, p in enumerate(prompts):
                try:
                    answers_.append(list(fn(pd.Series([p])))[0])
                except Exception as e:  # noqa: BLE001
                    answers_.append(GEN_ERROR)
                    errors[i] = f"{type(e).__name__}: {e}"
    ended = time.time()
    return answers_, errors, ended, ended - started


def _answered(batch: pa.RecordBatch, answers_: list, errors: list, ended: float, seconds: float,
              out_col: str, error_col: str, telemetry: bool) -> pa.RecordBatch:
    """The batch with its answers appended; its own columns stay Arrow."""
    n = batch.num_rows
    text = [None if a is None or a != a else str(a) for a in answers_]
    more = {out_col: pa.array(text, pa.string()), error_col: pa.array(errors, pa.string())}
    if telemetry:
        more |= {c: pa.array([v] * n, pa.float64()) for c, v in
                 (("gen_end_ts", ended), ("gen_seconds", seconds), ("worker_peak_rss_mb", _worker_peak_rss_mb()))}
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])


def constant_model(df: DataFrame, out_col: str = "raw_answer", error_col: str = "error") -> DataFrame:
    """The constant model as a literal column (no Python worker at all)."""
    return df.withColumn(out_col, F.lit(CONSTANT_ANSWER)).withColumn(error_col, F.lit(None).cast("string"))


def answers(df: DataFrame, raw_col: str = "raw_answer", out_col: str = "predicted_answer") -> DataFrame:
    """F13-F16 after inference: the cleaned answer that gets scored. The
    error sentinel passes cleaning unchanged."""
    return df.withColumn(out_col, clean_answer(F.col(raw_col)))


def infer_by_model(df: DataFrame, models: dict[str, dict], model_col: str = "model", prompt_col: str = "prompt",
                   out_col: str = "raw_answer", error_col: str = "error", telemetry: bool = True) -> DataFrame:
    """U1-U3 for many runs in one job: rows carry their model name in
    ``model_col``; each task sorts its rows by model (no shuffle), builds each
    model's batch function once, calls it per slice and lets go of it before
    the next one (partition by model first to keep one model per task).
    Models of type ``constant`` answer with the constant text. ``telemetry``
    adds the per-slice samples described in :func:`infer`."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType()),
                                              T.StructField(error_col, T.StringType())]
                          + (TELEMETRY_FIELDS if telemetry else []))
    # factories are resolved (and unknown types rejected) on the driver and
    # shipped with the task; each task builds a model at most once
    factories = {name: _factory(cfg) for name, cfg in models.items()}

    def run(it):
        now, fn = None, None
        for batch in it:
            names = batch.column(model_col).to_pylist()
            start = 0
            while start < len(names):
                end = start + 1
                while end < len(names) and names[end] == names[start]:
                    end += 1
                if now != (names[start],):
                    fn = None                     # the last model goes before the next one loads
                    make = factories.get(names[start])
                    now, fn = (names[start],), make() if make is not None else None
                part = batch.slice(start, end - start)
                yield _answered(part, *_generate(fn, part.column(prompt_col).to_pandas()), out_col, error_col, telemetry)
                start = end

    ship(df.sparkSession)
    return df.sortWithinPartitions(model_col).mapInArrow(run, schema)


# Model selection by ``model_type``.
MODELS: dict[str, Callable] = {"constant": lambda cfg: None}


def _factory(config: dict):
    """Driver-side U3: a zero-argument builder of the model's batch function
    (``None`` builder result = the constant model)."""
    t = config.get("model_type", "constant")
    if t not in MODELS:
        raise ValueError(f"unknown model_type {t!r}; register it in MODELS")
    make = MODELS[t]
    return lambda: make(config)


def select_model(config: dict):
    """The batch function for a model config, built here (driver side);
    ``constant`` (or a config without a type) gives ``None``, the literal
    model. Unknown types are an error."""
    t = config.get("model_type", "constant")
    if t not in MODELS:
        raise ValueError(f"unknown model_type {t!r}; register it in MODELS")
    return MODELS[t](config)


def run_inference(df: DataFrame, config: dict, prompt_col: str = "prompt",
                  materialize_output: bool = True, telemetry: bool = False) -> DataFrame:
    """Generate with the configured model, then clean the answers.

    A real model's output is written once with a reliable checkpoint (shared
    checkpoint folder) before anything reads it, so predictions and metrics
    never trigger a second inference, not even after an executor loss.
    """
    t = config.get("model_type", "constant")
    if t == "constant":
        return answers(constant_model(df))
    raw = infer(df, prompt_col=prompt_col, factory=_factory(config), telemetry=telemetry)  # built once per task
    if materialize_output:
        raw = materialize(raw)
    return answers(raw)
