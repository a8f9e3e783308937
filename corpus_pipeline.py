"""A training corpus from the table ``documents``, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept;
its result is written as Parquet and read again as the next one's ``docs``. All but the
last return rows of ``documents`` with all their columns; the last returns the pieces of
the packed sequences. Every row is judged by its own text: rows without id like all
others, different texts under one id apart, and of rows that repeat id and text one
stays in the exact stage. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.llm.common import stored
from qaspark.llm.decontaminate import find_contamination
from qaspark.llm.exact_dedup import exact_dedup
from qaspark.llm.near_dedup import near_duplicates
from qaspark.llm.packing import pack_documents
from qaspark.llm.quality import keep_quality, train_quality
from qaspark.sources.tables import table

SHINGLE_WORDS = 5
PERCENT = 80


def _without(docs: DataFrame, found: Callable[[DataFrame, str], DataFrame], nulls_last: bool = True) -> DataFrame:
    """``docs`` without the rows that ``found(rows, key)`` names in its ``doc_id``; ``key`` is
    the column that tells rows apart. That is ``doc_id`` itself, unless ids are missing or
    repeated: then rows are numbered by (id, digest of the text), those without id first or
    last, in a written table. The rows stream past the names."""
    columns, key = docs.columns, "doc_id"
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id IS NULL OR n > 1").isEmpty():
        key = "row_key"
        while key in (c.lower() for c in columns):
            key += "_"
        place = F.col("doc_id").asc_nulls_last() if nulls_last else F.col("doc_id").asc_nulls_first()
        digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
        docs = stored(docs.orderBy(place, digest, F.rand(0)).withColumn(key, F.monotonically_increasing_id()), "rows")
    names = found(docs, key).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(names.hint("shuffle_hash"), key, "left_anti").select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 and more)."""
    return keep_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return _without(docs, lambda rows, key: exact_dedup(rows, key).filter("NOT kept"), nulls_last=False)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return _without(docs, lambda rows, key: near_duplicates(rows, key, size=SHINGLE_WORDS, percent=PERCENT).filter("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that copies a benchmark item."""
    return _without(docs, lambda rows, key: find_contamination(rows, table(spark, sf_dir, "benchmark"), key))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents, packed into sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("packing", pack)]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
