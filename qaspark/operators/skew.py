"""Hot-key salting for equi-joins whose big side may hold a third of its rows
under one key.

``skew_join(big, small, keys)`` joins as ``big.join(small, keys)`` would, but
rows of a hot key are spread over several buckets:

* hot keys come from a sample of ``big`` (a key with a large share of the rows
  cannot hide from it), each with one bucket per ``rows_per_bucket``
  estimated rows; the table holds at most ``max_hot`` keys (a ``limit``), so
  it is broadcast with a proven bound;
* a ``big`` row gets the bucket ``hash(row) mod buckets(key)`` -- a pure
  function of the row, identical on every retry;
* the ``small`` rows of a hot key are replicated once per bucket;
* the join runs on ``keys + bucket``; keys that are not hot keep one bucket and
  replicate nothing.

The result is exactly the plain join (every big row meets every small row of
its key once). Only joins that preserve the big side (inner, left) are
supported, since the small side is replicated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000
SAMPLE_OF = 20                 # one of so many rows is counted to find hot keys
NULL_BUCKETS = 4096            # rows with a null key match nothing; they are spread over these


def hot_keys(df: DataFrame, keys: list[str], rows_per_bucket: int = ROWS_PER_BUCKET,
             sample_of: int = SAMPLE_OF) -> DataFrame:
    """``(keys..., buckets)`` for every key estimated above ``rows_per_bucket`` rows. The
    sample is chosen by a hash of the row, so each evaluation gives the same buckets."""
    src = df if sample_of <= 1 else df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(sample_of)) == 0)
    counted = src.groupBy(*keys).agg((F.count(F.lit(1)) * max(1, sample_of)).alias("__rows"))
    return (counted.select(*keys, F.ceil(F.col("__rows") / F.lit(rows_per_bucket)).cast("int").alias("buckets"))
                   .filter(F.col("buckets") > 1))


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
              rows_per_bucket: int | None = None, sample_of: int | None = None) -> DataFrame:
    """``big.join(small, keys, how)`` with hot keys of ``big`` salted over as many buckets
    as their size asks for. The table of hot keys is joined as a table; Spark broadcasts
    it only if it proves small."""
    if how not in ("inner", "left", "left_outer"):
        raise ValueError("skew_join preserves the big side only: inner or left")
    hot = hot_keys(big, keys, rows_per_bucket or ROWS_PER_BUCKET, sample_of or SAMPLE_OF)
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    buckets = F.coalesce(F.col("buckets"), F.lit(1))
    b = (big.join(hot, on=keys, how="left")
            .withColumn("__bucket", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]),
                                           F.when(no_key, F.lit(NULL_BUCKETS)).otherwise(buckets)).cast("int"))
            .drop("buckets"))
    s = (small.join(hot, on=keys, how="left")
              .withColumn("__bucket", F.explode(F.sequence(F.lit(0), buckets - 1)))
              .drop("buckets"))
    return b.join(s, on=[*keys, "__bucket"], how=how).drop("__bucket")
