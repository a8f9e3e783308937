"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .decontaminate import find_contamination
from .exact_dedup import exact_dedup
from .licenses import scan_licenses
from .near_dedup import near_duplicates
from .packing import pack_documents
from .pii import pii_report
from .quality import classify_quality
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .token_files import token_file_report
from .whitening import whiten


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii_report(table(spark, sf_dir, "documents"))


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 35 words and more, removed from all documents."""
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, on sets of four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels outside fold 1."""
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents, fed to a new digest index in two parts."""
    return exact_dedup(table(spark, sf_dir, "documents"), parts=2)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes and more, removed from all documents but the first."""
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that copy a benchmark item, edited copies included."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, through a new digest cache."""
    return token_counts(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of all documents that have a licence paragraph."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as entropy-coded blocks and read back."""
    return token_file_report(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on the leading components of their covariance."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words and their usual form."""
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_pattern_packing, op3_substring_dedup, op4_near_dedup, op5_quality, op6_exact_dedup,
                                     op7_suffix_array_dedup, op8_decontamination, op9_token_counts, op10_license_scan,
                                     op11_token_files, op12_embedding_whitening, op13_spelling_variants)}
