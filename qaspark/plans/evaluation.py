"""End-to-end evaluation of one run (model × dataset × mode): the composition
of the operators, as one lazy plan around the single inference step.

    items ─► prepare (P1, P4, P5, P6) ─► prompt (F7-F11) ─► infer (U1-U3, U5,
    checkpointed) ─► clean (F13-F16) ─► score (F4, F6) ─► prediction records (P7)
                                                       └► run metrics (A1, A7)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import run_name
from ..functions.prompts import chat_messages, is_chat_model, render_prompt
from ..operators.aggregate import run_quality, run_record
from ..operators.infer import CONSTANT_MODEL_BYTES, answers, infer_by_model, run_inference
from ..operators.ingest import dataset_stats, prepare_items
from ..operators.score import score, to_prediction
from ..session import materialize


def evaluate_run(items: DataFrame, *, model: dict, dataset: dict, mode: dict,
                 system_prompt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Return ``(predictions, metrics)`` for one run.

    ``model`` / ``dataset`` / ``mode`` are config records (for example rows of
    the S6 dimensions as dicts): ``model['name']``, ``model.get('model_path')``,
    ``model.get('model_type')``; ``dataset['name']``; ``mode['name']``,
    ``mode.get('prompt_template')``, ``mode.get('max_samples')``,
    ``mode.get('context_type')``. Items carry ``ordinal, question, answer,
    context, metadata`` (S1/S4 schema) and optionally ``contexts``
    (``array<string>``, e.g. from :func:`qaspark.operators.retrieve.attach_contexts`);
    without it the run is closed-book (no contexts).
    """
    name = run_name(F.lit(model["name"]), F.lit(dataset["name"]), F.lit(mode["name"]))
    prepared = prepare_items(items, mode.get("max_samples"))
    template = F.lit(mode.get("prompt_template")).cast("string")
    system = F.lit(system_prompt).cast("string")
    # retrieved contexts, when the items carry them (see retrieve.attach_contexts)
    ctx = F.coalesce(F.col("contexts"), F.array().cast("array<string>")) if "contexts" in items.columns \
        else F.array().cast("array<string>")
    chat = is_chat_model(F.lit(model.get("model_path") or ""))
    prompted = prepared.withColumn("__ctx", ctx).withColumn(
        "prompt", F.when(chat, F.to_json(chat_messages("question", "__ctx", template, system)))
                   .otherwise(render_prompt("question", "__ctx", template, system)))
    real_model = model.get("model_type", "constant") != "constant"
    answered = run_inference(prompted, model, "prompt", telemetry=real_model)
    scored = score(answered, "predicted_answer", "truths").withColumn("run_id", name)
    # the source id, null when the line has none (no positional fallback)
    preds = to_prediction(scored, question_id="metadata.id", question="question",
                          prediction="predicted_answer", truths="answer",
                          context_type=F.lit(mode.get("context_type") or "none"),
                          model_name=F.lit(model["name"]), dataset_name=F.lit(dataset["name"]),
                          prompt="prompt", contexts="__ctx").withColumn("run_id", name)
    # one run: every piece below is a one-row global aggregate; they are merged
    # by a union + max (no join on a constant key, which would plan a cross join)
    q_aggs = [F.avg("substring_recall").alias("substring_recall"), F.avg("token_recall").alias("token_recall"),
              F.count(F.lit(1)).cast("bigint").alias("num_examples")]
    if real_model:
        # generation telemetry: first batch start to last batch end, peak worker RSS
        q_aggs += [(F.max("gen_end_ts") - F.min(F.col("gen_end_ts") - F.col("gen_seconds"))).alias("duration_seconds"),
                   F.max("worker_peak_rss_mb").alias("cpu_ram_used_mb")]
    quality = scored.agg(*q_aggs)
    stats = dataset_stats(items, mode.get("max_samples")).select(
        F.col("eval_size").alias("dataset_eval_size"), F.col("valid_count").alias("dataset_valid_count"),
        F.col("to_process").alias("dataset_to_process"))
    cols = quality.columns + stats.columns
    merged = (quality.unionByName(stats, allowMissingColumns=True)
              .agg(*[F.max(c).alias(c) for c in cols]))
    merged = (merged.withColumn("substring_recall", F.coalesce("substring_recall", F.lit(0.0)))
                    .withColumn("token_recall", F.coalesce("token_recall", F.lit(0.0)))
                    .withColumn("run_id", name))
    record = run_record(merged, ["run_id"], peak_cols=("cpu_ram_used_mb",), model_size_bytes=model_bytes(model),
                        extra_cols=("dataset_eval_size", "dataset_valid_count", "dataset_to_process"))
    metrics = (record.withColumn("model", F.lit(model["name"])).withColumn("dataset", F.lit(dataset["name"]))
                     .withColumn("experiment_mode", F.lit(mode["name"])))
    return preds, metrics


def model_bytes(config: dict) -> int:
    """Reported size of a model: ``model_size_bytes`` of its config; the constant model has a fixed one."""
    if config.get("model_type", "constant") == "constant":
        return CONSTANT_MODEL_BYTES
    return int(config.get("model_size_bytes") or 0)


def spark_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def evaluate_grid(items: DataFrame, grid: DataFrame, models: dict[str, dict], mode: dict,
                  dataset_col: str = "dataset", system_prompt: str | None = None,
                  materialize_output: bool = True) -> tuple[DataFrame, DataFrame]:
    """Evaluate every run of a grid in one job.

    ``items`` carries a ``dataset`` column next to the S1 item columns;
    ``grid`` has one row per run with ``model``, ``dataset`` and ``run_name``
    (for example :func:`qaspark.operators.grid.run_grid`) and optionally
    ``model_path``; ``models`` maps a model name to its config (``model_type``
    selects the batch function). Each item is evaluated by every model whose
    grid row names its dataset. Returns ``(predictions, metrics)``; metrics
    have one row per grid run, 0.0 / 0.0 / 0 for a run without items.
    """
    g = grid.select(F.col("run_name").alias("run_id"), "model", F.col("dataset").alias(dataset_col),
                    (F.col("model_path") if "model_path" in grid.columns else F.lit("")).alias("model_path"))
    prepared = prepare_items(items, mode.get("max_samples"), [dataset_col] if mode.get("max_samples") else None)
    runs_items = prepared.join(g, on=dataset_col, how="inner")
    template = F.lit(mode.get("prompt_template")).cast("string")
    system = F.lit(system_prompt).cast("string")
    ctx = F.coalesce(F.col("contexts"), F.array().cast("array<string>")) if "contexts" in items.columns \
        else F.array().cast("array<string>")
    prompted = runs_items.withColumn("__ctx", ctx).withColumn(
        "prompt", F.when(is_chat_model("model_path"), F.to_json(chat_messages("question", "__ctx", template, system)))
                   .otherwise(render_prompt("question", "__ctx", template, system)))
    # one model per task where possible (a task loads each model it meets): hash-partition the
    # prompts by (model, salt); the salt splits a model's items over several tasks
    slices = max(1, int(spark_partitions(items)) // max(1, len(models)))
    salt = F.pmod(F.xxhash64(F.col("ordinal")), F.lit(slices))
    prompted = prompted.repartition(F.col("model"), salt)
    raw = infer_by_model(prompted, models)
    if materialize_output:
        raw = materialize(raw)
    scored = score(answers(raw), "predicted_answer", "truths")
    preds = to_prediction(scored, question_id="metadata.id", question="question", prediction="predicted_answer",
                          truths="answer", context_type=F.lit(mode.get("context_type") or "none"),
                          model_name="model", dataset_name=dataset_col, prompt="prompt", contexts="__ctx", keep=["run_id"])
    quality = run_quality(scored, g.select("run_id"), ["run_id"])
    tel = scored.groupBy("run_id").agg(
        (F.max("gen_end_ts") - F.min(F.col("gen_end_ts") - F.col("gen_seconds"))).alias("duration_seconds"),
        F.max("worker_peak_rss_mb").alias("cpu_ram_used_mb"))
    sizes = items.sparkSession.createDataFrame([(n, model_bytes(c)) for n, c in models.items()], "model string, model_size_bytes long")
    sized = g.select("run_id", "model").join(sizes, "model", "left").drop("model")
    record = run_record(quality, ["run_id"], durations=tel, sizes=sized, peak_cols=("cpu_ram_used_mb",))
    stats = dataset_stats(items, mode.get("max_samples"), [dataset_col]).select(
        dataset_col, F.col("eval_size").alias("dataset_eval_size"),
        F.col("valid_count").alias("dataset_valid_count"), F.col("to_process").alias("dataset_to_process"))
    metrics = (record.join(g.select("run_id", "model", dataset_col), on="run_id", how="inner")
               .join(stats, on=dataset_col, how="left")
               .withColumn("experiment_mode", F.lit(mode["name"])))
    return preds, metrics
