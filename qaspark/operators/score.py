"""Scoring: truth resolution, prediction/truth pairing, both recalls and the
prediction record (P6, P7, P14, J3, F4-F6 applied to DataFrames)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_sentinel, with_recalls


def resolve_truth(all_answers, answer) -> Column:
    """``all_answers`` when it has elements, else ``answer`` (an empty list
    falls through)."""
    aa = F.col(all_answers) if isinstance(all_answers, str) else all_answers
    a = F.col(answer) if isinstance(answer, str) else answer
    return F.when(F.coalesce(F.size(aa) > 0, F.lit(False)), aa).otherwise(a)


def pair_predictions(items: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join of items and predictions on ``keys``.

    Both sides are hash-partitioned on all keys, so a run that holds a large
    share of the rows is still spread over many tasks.
    """
    return items.join(predictions, on=keys, how="inner")


def pair_next_turn(conversations: DataFrame, question_role: str = "user",
                   answer_role: str = "assistant") -> DataFrame:
    """Pair each ``question_role`` turn with the ``answer_role`` turn that
    directly follows it in the same conversation (``turn + 1``).

    An equi-join on ``(conv_id, turn)``: no window partitioned by conversation,
    so one huge conversation does not land in a single task.
    """
    q = (conversations.filter(F.col("role") == question_role)
         .select("conv_id", "turn", F.col("text").alias("question")))
    a = (conversations.filter(F.col("role") == answer_role)
         .select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction")))
    return pair_predictions(q, a, ["conv_id", "turn"])


def score(df: DataFrame, prediction: str = "prediction", truths: str = "truths") -> DataFrame:
    """Add ``substring_recall`` and ``token_recall`` (both always computed) and
    the sentinel flag. Sentinel answers are scored like any other answer."""
    return with_recalls(df, prediction, truths).withColumn("is_sentinel", is_sentinel(F.col(prediction)))


def to_prediction(df: DataFrame, *, question_id: str, question: str, prediction: str,
                  truths: str, context_type, model_name, dataset_name,
                  prompt: str | None = None, contexts: str | None = None,
                  keep: list[str] | None = None) -> DataFrame:
    """The prediction record, with honest names for both recalls and a
    ``metadata`` struct (dataset, ``token_recall_tokens``, then the item's
    metadata fields such as ``id``, ``question_id``, ``all_answers``).

    ``context_type``/``model_name``/``dataset_name`` are column names or
    Columns (use ``F.lit`` for a constant run attribute); ``keep`` columns
    (e.g. ``run_id``) are carried through in front.
    """
    def col(x):
        return F.col(x) if isinstance(x, str) else x
    # metadata: dataset and token recall first, then the item's own metadata fields
    # (struct fields instead of a dict merge; the item struct has no colliding keys)
    meta = [col(dataset_name).alias("dataset"), F.col("token_recall").alias("token_recall_tokens")]
    if "metadata" in df.columns:
        item_meta = df.schema["metadata"].dataType
        meta += [F.col(f"metadata.{f.name}").alias(f.name) for f in item_meta.fields
                 if f.name not in ("dataset", "token_recall_tokens")]
    return df.select(
        *(keep or []),
        col(question_id).cast("string").alias("question_id"),
        col(question).alias("question"),
        col(prediction).alias("predicted_answer"),
        col(truths).alias("ground_truth"),
        (col(contexts) if contexts else F.array().cast("array<string>")).alias("contexts"),
        col(context_type).alias("context_type"),
        col(model_name).alias("model_name"),
        col(dataset_name).alias("dataset_name"),
        F.col("substring_recall"),
        F.col("token_recall"),
        F.col("is_sentinel"),
        (col(prompt) if prompt else F.lit(None).cast("string")).alias("prompt"),
        F.struct(*meta).alias("metadata"),
    )
