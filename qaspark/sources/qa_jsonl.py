"""QA sources (S1-S5): JSON Lines question/answer files, the parsed snapshot,
the synthetic smoke source and the source registry.

One JSON object per line: ``question_id`` (any scalar, optional),
``question`` (string), ``answer`` (null, a scalar or a list). ``answer`` may be
a scalar *or* a list, so lines are parsed to VARIANT (``parse_json``) and the
JSON type decides; ``spark.read.json`` would read both as one STRING column
and could not tell the string ``"[a]"`` from a list.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS_CLASS, strip_ws

ITEM_SCHEMA = ("ordinal struct<file:string,block:bigint,row:bigint>, question string, answer array<string>, "
               "context string, metadata struct<id:string,question_id:string,all_answers:array<string>>")


FIELDS = "question_id string, question string, answer string"


def _ordinal() -> Column:
    """File order: (file path, split start, row within split) -- attached at
    read time, before any shuffle."""
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their file order. A missing path fails at
    analysis, before any job runs."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), _ordinal().alias("ordinal"))
    return raw.filter(_non_blank(F.col("line")))


def _non_blank(line: Column) -> Column:
    return F.regexp_replace(line, f"^{WS_CLASS}+$", "") != ""


def _type(v: Column) -> Column:
    """JSON type of a VARIANT value, such as ``STRING`` or ``OBJECT<...>``; null stays null."""
    return F.schema_of_variant(v)


def _question(v: Column, text: Column) -> Column:
    """A question that is false in the source's sense (zero, false, an empty list or
    object) is no question; any other value is its text."""
    number = text.try_cast("double")
    falsy = text.isin("false", "[]", "{}") | (F.coalesce(number, F.lit(1.0)) == 0)
    return F.when(_type(v).eqNullSafe("STRING") | ~falsy, text)


def normalize_answer(v: Column, raw: Column) -> Column:
    """VARIANT answer and its text (a string as is, any other value as the line writes
    it) → ``array<string>``.

    A list keeps its non-null elements whose text is not blank (survivors are
    *not* stripped); a scalar is stripped and wrapped, blank → null; null or
    absent → null. Small expressions on purpose: they stay inside whole-stage
    code generation.
    """
    is_list = F.coalesce(_type(v).startswith("ARRAY"), F.lit(False))
    kept = F.filter(F.from_json(raw, "array<string>"), lambda x: x.isNotNull() & (strip_ws(x) != ""))
    scalar = strip_ws(raw)
    return (F.when(is_list, kept)
             .when(scalar.isNull() | (scalar == ""), F.lit(None).cast("array<string>"))
             .otherwise(F.array(scalar)))


def parse_items(lines: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1 + P3: parsed items and the malformed lines.

    ``strict`` parses with ``parse_json`` (a malformed line fails the job, as
    the file load would); otherwise ``try_parse_json`` and malformed lines go
    to the second DataFrame (``bad_records``).
    """
    parse = F.parse_json if strict else F.try_parse_json
    # The parse is the output of a one-element inline: Catalyst does not push
    # predicates on a generator's output below it, so a later filter on a
    # parsed field (e.g. P1) reads the parsed value instead of re-parsing the
    # line. The CASE keeps blank lines away from the parser.
    parsed = F.array(F.struct(F.when(_non_blank(F.col("line")), parse(F.col("line"))).alias("v"),
                              F.from_json("line", FIELDS).alias("t")))
    j = lines.select("ordinal", "line", F.inline(parsed))
    # a line that is JSON but no object is malformed too
    record = F.coalesce(_type(F.col("v")).startswith("OBJECT"), F.lit(False))
    bad = j.filter(~record).select("ordinal", "line")
    if strict:
        checked = F.when(record, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("line", 1, 200))))
        ok = j.withColumn("v", checked)
    else:
        ok = j.filter(record)
    # the types come from the VARIANT, the texts as the line writes them (3.0 stays 3.0)
    qid = F.when(F.try_variant_get("v", "$.question_id", "variant").isNotNull(), F.col("t.question_id"))
    question = _question(F.try_variant_get("v", "$.question", "variant"), F.col("t.question"))
    answer = normalize_answer(F.try_variant_get("v", "$.answer", "variant"), F.col("t.answer"))
    # each field is computed once; the struct below only references columns
    staged = ok.select("ordinal", qid.alias("__qid"), question.alias("question"), answer.alias("answer"))
    items = staged.select(
        "ordinal", "question", "answer", F.lit(None).cast("string").alias("context"),
        F.struct(F.col("__qid").alias("id"), F.col("__qid").alias("question_id"),
                 F.col("answer").alias("all_answers")).alias("metadata"))
    return items, bad


def read_qa(spark: SparkSession, path: str, strict: bool = True, dataset_from_file: bool = False,
            bad_records: str | None = None) -> DataFrame:
    """All records of a QA JSONL file or folder (``eval_size`` counts
    these). ``dataset_from_file`` adds ``dataset`` = the source file's stem,
    so one folder of files feeds a multi-dataset grid. Lenient reading writes the
    malformed lines, with their file and place, to ``bad_records`` if that is given."""
    items, bad = parse_items(read_lines(spark, path), strict)
    if bad_records and not strict:
        bad.write.mode("overwrite").json(bad_records)
    if dataset_from_file:
        items = items.withColumn("dataset", F.regexp_extract(F.col("ordinal.file"), r"([^/]+?)(\.[^./]*)?$", 1))
    return items


def snapshot(items: DataFrame, snapshot_path: str, key: str | None = None, refresh: bool = False) -> DataFrame:
    """S3: the parsed items as Parquet, written once per ``key`` (for example the source
    path and its modification time) and read back: later runs with that key read the
    finished snapshot, prune columns and push filters into it instead of re-parsing.
    Without a key, or with ``refresh``, it is written anew."""
    spark = items.sparkSession
    path = f"{snapshot_path}/{hashlib.sha256(key.encode()).hexdigest()[:24]}" if key else snapshot_path
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
    if refresh or not key or not found:
        items.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def synthetic_items(spark: SparkSession, n: int = 10) -> DataFrame:
    """``Test question i`` / ``Test answer i`` / ``Test context i``."""
    r = spark.range(n)
    i = F.col("id").cast("string")
    return r.select(
        F.struct(F.lit("synthetic").alias("file"), F.lit(0).cast("bigint").alias("block"),
                 F.col("id").alias("row")).alias("ordinal"),
        F.concat(F.lit("Test question "), i).alias("question"),
        F.array(F.concat(F.lit("Test answer "), i)).alias("answer"),
        F.concat(F.lit("Test context "), i).alias("context"),
        F.struct(i.alias("id"), F.lit(None).cast("string").alias("question_id"),
                 F.lit(None).cast("array<string>").alias("all_answers")).alias("metadata"))


# Source registry -- dataset type → loader(spark, config dict).
REMOVED_TYPES = {"mirage": "dataset type 'mirage' was removed; use type qa_pairs_jsonl with qa_pairs_path"}
SOURCES = {
    "qa_pairs_jsonl": lambda spark, cfg: read_qa(spark, cfg["qa_pairs_path"], cfg.get("strict", True)),
    "synthetic": lambda spark, cfg: synthetic_items(spark, int(cfg.get("n", 10))),
}


def dataset_source(spark: SparkSession, config: dict) -> DataFrame:
    """DataFrame for a dataset config by its ``type``; a removed or unknown
    type is an error (no silent fallback to the synthetic source)."""
    t = config.get("type")
    if t in REMOVED_TYPES:
        raise ValueError(REMOVED_TYPES[t])
    if t not in SOURCES:
        raise ValueError(f"unknown dataset type {t!r}; known: {sorted(SOURCES)}")
    return SOURCES[t](spark, config)
