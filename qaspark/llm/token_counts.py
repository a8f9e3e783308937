"""Token counts through a digest cache.

Each text is reduced to a digest; digests joined with the cache table give the counts
already known for this tokenizer version, the library encodes only one text of each
remaining digest, and the new counts are appended to the cache. The digest is that of
the text as it is (a null one as empty): any further normalisation would change counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, shared_path, stored
from .tokens import encoder, vocabulary_path

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file, of the pattern and of both libraries that encode by it."""
    import public_tokenizers
    import tiktoken
    import tokenizers
    with open(path, "rb") as f:
        parts = [f.read(), tokenizers.__version__.encode(), tiktoken.__version__.encode(), public_tokenizers.PATTERN.encode()]
    return hashlib.sha256(b"\n".join(parts)).hexdigest()[:32]


class CountCache:
    """Parquet folder of ``(digest, tokenizer, n_tokens)``; a fresh shared one by default."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "token-cache")
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(self.path)

    def read(self, tokenizer: str) -> DataFrame:
        return (self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)
                .filter(F.col("tokenizer") == tokenizer).select("digest", "n_tokens"))

    def append(self, counts: DataFrame, tokenizer: str) -> None:
        """Add counts of digests that the cache lacks."""
        counts.select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(self.path)


def _counter(vocabulary: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path(vocabulary))
        for b in batches:
            n = [len(enc.encode(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])
    return count


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = "byte_bpe_50k.json", limit: int = 512,
                 cache: CountCache | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``n_tokens`` equals the length of the library's ids of the whole text without
    added special tokens. Null texts are empty (0 bytes, 0 tokens), null ids and
    repeated rows are kept as they are, equal texts are encoded once, an empty table
    gives no rows. The text is shuffled once, by id, and streamed past the small table
    of misses; the copies of a text that a third of all rows may hold stay behind.
    """
    spark = docs.sparkSession
    cache = cache or CountCache(spark)
    version = tokenizer_version(vocabulary_path(vocabulary))
    texts = prepared(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    rows = stored(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "text-digests")
    misses = (rows.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("row"))
              .join(cache.read(version), "digest", "left_anti"))
    one_each = (texts.withColumn("row", F.coalesce("doc_id", F.lit(0)))
                .join(misses.hint("shuffle_hash"), ["row", "digest"], "left_semi").select("digest", "text"))
    counted = one_each.mapInArrow(_counter(vocabulary), "digest binary, n_tokens long")
    # an id that repeats may bring the same text twice
    cache.append(counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), version)
    return (rows.join(cache.read(version), "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
