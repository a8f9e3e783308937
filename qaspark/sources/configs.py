"""Model / dataset / mode dimensions from the resolved config files.

Config files are small flat ``key: value`` YAML documents; they are read with
``spark.read.text(wholetext=True)`` (one row per file) and the fields are
extracted with regular expressions -- no YAML library and no driver loop.
Rows come sorted by file stem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_FIELDS = ("name", "model_type", "model_size", "model_path", "temperature", "device",
                "use_flash_attention", "load_in_8bit", "gradient_checkpointing")
DATASET_FIELDS = ("name", "type", "qa_pairs_path", "cache_dir")
MODE_FIELDS = ("name", "description", "use_retriever", "context_type", "prompt_template", "max_samples")


def yaml_field(text: Column, key: str) -> Column:
    """Top-level scalar ``key: value`` of a flat YAML text (quotes and trailing
    comments removed; ``null`` → null)."""
    raw = F.regexp_extract(text, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1)
    unq = F.when(raw.rlike(r'^".*"$'), F.regexp_extract(raw, r'^"(.*)"$', 1)) \
           .when(raw.rlike(r"^'.*'$"), F.regexp_extract(raw, r"^'(.*)'$", 1)) \
           .otherwise(F.regexp_replace(raw, r"[ \t]+#.*$", ""))
    unq = F.replace(unq, F.lit("\\n"), F.lit("\n"))
    return F.when((raw == "") | (unq == "null") | (unq == "~"), F.lit(None).cast("string")).otherwise(unq)


def yaml_list(text: Column, key: str) -> Column:
    """Top-level block list ``key:`` followed by ``- item`` lines → ``array<string>``
    (empty when the key is absent)."""
    block = F.regexp_extract(text, rf"(?m)^{key}:[ \t]*(?:#.*)?\n((?:[ \t]+-[^\n]*(?:\n|$))*)", 1)
    return F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]+-[ \t]*([^#\n]*?)[ \t]*(?:#.*)?$"), 1)


def config_dimension(spark: SparkSession, folder: str, fields: tuple[str, ...]) -> DataFrame:
    files = spark.read.text(f"{folder.rstrip('/')}/*.yaml", wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.ya?ml$", 1)
    df = files.select(stem.alias("stem"), *[yaml_field(F.col("value"), f).alias(f) for f in fields])
    return df.orderBy("stem")


def models(spark: SparkSession, folder: str) -> DataFrame:
    d = config_dimension(spark, folder, MODEL_FIELDS)
    return (d.withColumn("temperature", F.col("temperature").try_cast("double"))
             .withColumn("use_flash_attention", F.col("use_flash_attention").try_cast("boolean"))
             .withColumn("load_in_8bit", F.col("load_in_8bit").try_cast("boolean"))
             .withColumn("gradient_checkpointing", F.col("gradient_checkpointing").try_cast("boolean")))


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    return config_dimension(spark, folder, DATASET_FIELDS)


def modes(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.text(f"{folder.rstrip('/')}/*.yaml", wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.ya?ml$", 1)
    d = files.select(stem.alias("stem"), *[yaml_field(F.col("value"), f).alias(f) for f in MODE_FIELDS],
                     yaml_list(F.col("value"), "metrics").alias("metrics")).orderBy("stem")
    return (d.withColumn("use_retriever", F.col("use_retriever").try_cast("boolean"))
             .withColumn("max_samples", F.col("max_samples").try_cast("bigint")))
