"""Token-recall join -- all (truth, text) pairs whose token recall
``|T ∩ D| / |T|`` reaches a threshold, without a cross product.

Plan (published set-similarity-join technique, prefix filtering):

1. truth token sets ``(tid, token)`` and text postings ``(did, token)``; the
   postings are semi-joined to the truth vocabulary first, so tokens no truth
   uses never reach a shuffle;
2. document frequency per token (partial aggregation, hot tokens are
   pre-reduced per task), from a sample of the texts by default;
3. each truth keeps its ``n - m + 1`` rarest tokens (``m`` = smallest overlap
   that can reach the threshold). A text reaching the threshold must contain
   one of them, so the prefix join finds every result;
4. candidates = prefix tokens ⋈ postings on ``(token, salt)``: a hot token's
   postings are spread over buckets (one per ``rows_per_salt`` estimated
   postings, by a hash of the text id) and its prefix rows are replicated
   per bucket, so a token present in a third of all texts is split over many
   tasks; rare tokens keep one bucket;
5. exact verification of each candidate by counting shared tokens (equi-join
   on ``(did, token)``), then the threshold filter.

Pairs below the threshold -- including zero scores -- are not output.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import bounded_rows, materialize
from .skew import skew_join

ROWS_PER_SALT = 1_000_000        # postings per salt bucket of a hot token
DF_SAMPLE = 0.05                 # share of texts, by a hash of their id, whose frequencies order the tokens
BROADCAST_MAX_ROWS = 500_000     # proven-size bound for the truth-side broadcast


def truth_token_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, token, n_tokens)`` -- one row per distinct token of each text."""
    t = df.select(F.col(id_col).alias("tid"), tokens(F.col(text_col)).alias("__t"))
    return t.select("tid", F.size("__t").cast("bigint").alias("n_tokens"), F.explode("__t").alias("token"))


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(did, token)`` -- one row per distinct token of each text."""
    return df.select(F.col(id_col).alias("did"), F.explode(tokens(F.col(text_col))).alias("token"))


def min_overlap(threshold: float, n_col: str = "n_tokens"):
    """Lower bound of the overlap needed to reach ``threshold`` (rounded down so
    the prefix can only be longer than necessary, never shorter)."""
    return F.greatest(F.lit(1), F.floor(F.col(n_col) * F.lit(float(threshold)) - F.lit(1e-9)))


def recall_join(truths: DataFrame, texts: DataFrame, truth_id: str, truth_text: str,
                text_id: str, text_col: str, threshold: float,
                rows_per_salt: int | None = None, df_sample: float | None = DF_SAMPLE,
                materialize_postings: bool = False) -> DataFrame:
    """Pairs ``(truth_id, text_id, overlap, n_tokens, token_recall)`` with
    ``token_recall >= threshold`` (``0 < threshold <= 1``).

    Prefix filtering is exact for *any* fixed global token order; rarest
    first only keeps the candidate set small. So the document frequencies
    that set the order may come from a sample of the texts (``df_sample``),
    which saves one full tokenising pass. ``materialize_postings`` writes the
    vocabulary-filtered postings once with a reliable checkpoint (shared
    checkpoint folder) and reads them for every later step instead of
    tokenising the texts again; frequencies are then exact.
    """
    if not (0.0 < threshold <= 1.0) or math.isnan(threshold):
        raise ValueError("threshold must be in (0, 1]")
    rows_per_salt = rows_per_salt or ROWS_PER_SALT
    tt = truth_token_rows(truths, truth_id, truth_text)
    tt_is_small = bounded_rows(tt, BROADCAST_MAX_ROWS) is not None
    tt_small = F.broadcast(tt) if tt_is_small else tt
    vocab = tt_small.select("token").distinct()
    post = postings(texts, text_id, text_col).join(vocab, on="token", how="left_semi")
    if materialize_postings:
        post = materialize(post)
        freq_src = post
    elif df_sample and df_sample < 1.0:
        # chosen by a hash, so that every evaluation finds the same frequencies and buckets
        some = F.pmod(F.xxhash64(text_id), F.lit(10_000)) < F.lit(int(df_sample * 10_000))
        freq_src = postings(texts.filter(some), text_id, text_col).join(vocab, on="token", how="left_semi")
    else:
        freq_src = post

    dfreq = freq_src.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # tt is the preserved (left) side here, so the broadcast hint would not apply
    ranked = (tt.join(dfreq, on="token", how="left")
              .withColumn("df", F.coalesce("df", F.lit(0)))
              .withColumn("r", F.row_number().over(
                  Window.partitionBy("tid").orderBy("df", "token"))))
    prefix = ranked.filter(F.col("r") <= F.col("n_tokens") - min_overlap(threshold) + 1)

    # per-token salting: a token's postings are spread over buckets in
    # proportion to its (estimated) frequency; the prefix rows of that token
    # are replicated once per bucket. Only hot tokens get more than one.
    scale = (1.0 / df_sample) if (df_sample and df_sample < 1.0 and not materialize_postings) else 1.0
    nsalt = F.greatest(F.lit(1), F.ceil(F.col("df") * F.lit(scale) / F.lit(rows_per_salt)))
    hot = dfreq.select("token", nsalt.cast("int").alias("nsalt")).filter(F.col("nsalt") > 1)
    buckets = F.coalesce(F.col("nsalt"), F.lit(1))
    salted_prefix = (prefix.join(hot, on="token", how="left")
                     .select("tid", "token", F.explode(F.sequence(F.lit(0), buckets - 1)).alias("salt")))
    salted_post = (post.join(hot, on="token", how="left")
                   .select("did", "token", F.pmod(F.xxhash64("did"), buckets).cast("int").alias("salt")))
    cand = (salted_prefix.join(salted_post, on=["token", "salt"], how="inner")
            .select("tid", "did").distinct())

    # a uniform equi-join on (did, token); restricting it to candidate texts
    # first was measured slower -- it costs another pass over the texts
    # a broadcast when the truth tokens are small; otherwise a truth with very
    # many candidate texts is a hot key, salted by skew_join
    expanded = cand.join(tt_small, on="tid", how="inner") if tt_is_small else skew_join(cand, tt, ["tid"])
    overlap = (expanded
                   .join(post, on=["did", "token"], how="inner")
                   .groupBy("tid", "did", "n_tokens")
                   .agg(F.count(F.lit(1)).cast("bigint").alias("overlap")))
    scored = overlap.withColumn("token_recall", F.col("overlap") / F.col("n_tokens"))
    return (scored.filter(F.col("token_recall") >= F.lit(float(threshold)))
                  .select(F.col("tid").alias(truth_id), F.col("did").alias(text_id),
                          "overlap", "n_tokens", "token_recall"))
