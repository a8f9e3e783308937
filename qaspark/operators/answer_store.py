"""Answers kept between runs (U1, U5): a model is asked each prompt once.

A store is a folder of Parquet rows ``(digest, raw_answer, error, at)`` below one
folder per run and model. A run anti-joins its distinct prompts with the good answers
of its model, generates the rest, writes them as a folder of its own and joins all rows
with the store. So a prompt that many rows share is generated once, a second run over
the same rows calls the model for failed prompts only, and a run that died resumes from
whatever earlier runs had written. What is read afterwards are files: the model never
runs again, also not when an executor is lost.

The digest covers the prompt (a null prompt has one of its own), the model key the whole
model config: a changed setting asks anew. Runs may write to one store at the same time;
where two answered the same prompt, the earliest good answer counts for all.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import delete_folder, exists, folders_in
from .infer import _factory, infer
from .skew import skew_join

SCHEMA = "digest string, raw_answer string, error string, at timestamp, run string, model string"


def model_key(config: dict) -> str:
    """Name of a model config in the store; it changes with any of its settings."""
    text = json.dumps(config, sort_keys=True, default=str)
    return "m" + hashlib.sha256(text.encode()).hexdigest()[:24]     # a letter first: never read as a number


def prompt_digest(prompt: Column) -> Column:
    return F.coalesce(F.sha2(F.encode(prompt, "UTF-8"), 256), F.lit("null"))


class AnswerStore:
    """Answers of any number of models below ``path`` (a folder all executors share)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self, config: dict) -> DataFrame:
        """One row per prompt that the model was asked: ``digest, raw_answer, error, run``.
        The earliest good answer counts, without one the latest error. The model's folders
        alone are read."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA).select("digest", "raw_answer", "error", "run")
        found = self.spark.read.schema(SCHEMA).parquet(self.path).filter(F.col("model") == model_key(config))
        failed = F.col("error").isNotNull()
        when = F.unix_micros("at")
        order = F.struct(failed, F.when(failed, -when).otherwise(when), "run")
        return (found.groupBy("digest").agg(F.min_by(F.struct("raw_answer", "error", "run"), order).alias("a"))
                .select("digest", "a.*"))

    def answer(self, df: DataFrame, config: dict, prompt_col: str = "prompt", out_col: str = "raw_answer",
               error_col: str = "error", known_col: str | None = None, generate: Callable | None = None,
               tasks: int | None = None) -> DataFrame:
        """Every row of ``df`` with its answer and error (null unless it failed, U5).

        ``generate`` is a light batch function; without it the model of ``config`` is built
        once per task (U3). ``known_col`` tells whether the answer stood in the store before.
        ``tasks`` is the number of tasks that generate (default: the session's shuffle
        partitions); Spark's own choice goes by bytes, and prompts are few bytes for much work.
        """
        rows = df.withColumn("__digest", prompt_digest(F.col(prompt_col)))
        good = self.rows(config).filter("error IS NULL").select(F.col("digest").alias("__digest"))
        asked = rows.groupBy("__digest").agg(F.first(prompt_col).alias("prompt")).join(good, "__digest", "left_anti")
        asked = asked.repartition(tasks or int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        new = infer(asked, generate, factory=None if generate else _factory(config))
        run = "r" + uuid.uuid4().hex
        (new.select(F.col("__digest").alias("digest"), "raw_answer", "error", F.current_timestamp().alias("at"),
                    F.lit(model_key(config)).alias("model"))
         .write.partitionBy("model").parquet(f"{self.path}/run={run}"))
        kept = self.rows(config).select(F.col("digest").alias("__digest"), F.col("raw_answer").alias("__raw"),
                                        F.col("error").alias("__error"), (F.col("run") != run).alias("__known"))
        names = {"__raw": out_col, "__error": error_col, **({"__known": known_col} if known_col else {})}
        clean = rows.drop(*names.values())
        return skew_join(clean, kept, ["__digest"], "left").select(
            *[c for c in df.columns if c not in names.values()], *(F.col(k).alias(v) for k, v in names.items()))

    def compact(self, configs: list[dict]) -> None:
        """Write the answers of these models as one run and delete their earlier runs. The
        new folder is complete before any other goes, so a crash leaves answers twice, never
        less; no other run may write meanwhile."""
        old = folders_in(self.spark, self.path)
        for config in configs:
            model, run = model_key(config), "r" + uuid.uuid4().hex
            (self.rows(config).select("digest", "raw_answer", "error", F.current_timestamp().alias("at"), F.lit(model).alias("model"))
             .write.partitionBy("model").parquet(f"{self.path}/run={run}"))
            for folder in old:
                delete_folder(self.spark, f"{folder}/model={model}")
