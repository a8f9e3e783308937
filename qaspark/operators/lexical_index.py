"""A lexical index on disk with early-ending top-k search.

Postings are kept in blocks of neighbouring document ids, one row ``(token, block, n, ids)``
per token of a block with its ids in order. Texts are shuffled once, by block; the postings
are made where a block lies and never moved. A search orders the tokens
of a query by document frequency and reads the lists of the rare half first. The k-th best
count ``c`` found there bounds the result from below: a text that holds none but the
``c - 1`` most frequent tokens cannot enter, so their lists, the longest ones, are never
read. The lists between are read as well, and then only those blocks of the longest lists
are probed in which a text that can still reach the threshold would stand. The result is
that of a scan over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import broadcast_if_bounded, materialize
from ..shipping import ship
from ..sources.folders import finished, fingerprint, listing, shared_folder
from .retrieve import _final_top_k, each_with

BLOCK_BITS = 10                # a block covers 2**BLOCK_BITS neighbouring ids
HELD = 1 << 21                 # postings of a block after which repeated ones are dropped
ROWS_OUT = 1 << 14             # rows of postings handed on together, about
FEW_WORDS = 200_000            # words of queries, at most, that are broadcast
LAYOUT = "blocks without buckets"
LEFT_OUT = 0.5                 # share of a query's tokens, the most frequent ones, left out at first
LONG_LIST = 64                 # tokens in fewer texts are never left out


def _blocks(bits: int):
    """``(block, id, tokens)`` rows sorted by block as posting rows."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, low, toks, ready = None, [], [], []

        def postings() -> tuple[np.ndarray, np.ndarray, pa.Array]:
            """The distinct postings held, as places in the token list and low bits of the id."""
            coded = pa.concat_arrays(toks).dictionary_encode()
            key = np.unique(coded.indices.to_numpy().astype(np.int64) << bits | np.concatenate(low))
            return key >> bits, key & (1 << bits) - 1, coded.dictionary

        def done() -> None:
            if sum(map(len, toks)):
                token, bottom, names = postings()
                start = np.flatnonzero(np.diff(token, prepend=-1))
                ids = pa.ListArray.from_arrays(pa.array(np.append(start, len(token)), pa.int32()), pa.array((now << bits) | bottom))
                n = np.diff(np.append(start, len(token))).astype(np.int32)
                ready.append(pa.RecordBatch.from_arrays([names, pa.array(np.full(len(start), now), pa.int64()), ids, pa.array(n)],
                                                        ["token", "block", "ids", "n"]))
            low.clear()
            toks.clear()

        def handed() -> Iterator[pa.RecordBatch]:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches(max_chunksize=ROWS_OUT)
            ready.clear()
        for b in batches:
            block, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = [*np.flatnonzero(np.diff(block, prepend=block[:1] - 1)).tolist(), len(block)]
            for a, z in zip(edges, edges[1:]):
                if block[a] != now:
                    if now is not None:
                        done()
                        if sum(r.num_rows for r in ready) >= ROWS_OUT:
                            yield from handed()
                    now = int(block[a])
                lists = b.column(2).slice(a, z - a)
                toks.append(pc.list_flatten(lists))
                low.append((ids[a:z] & (1 << bits) - 1)[pc.list_parent_indices(lists).to_numpy()])
                if sum(map(len, toks)) > HELD:
                    token, bottom, names = postings()
                    toks[:], low[:] = [names.take(pa.array(token))], [bottom]
        if now is not None:
            done()
        if ready:
            yield from handed()
    return pack


class LexicalIndex:
    """An index folder: ``postings/batch=…`` and ``ids/batch=…`` (all texts, those
    without words too). A text is named by its id; rows that repeat an id are one text."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, corpus: DataFrame, id_col: str, text_col: str, path: str | None = None) -> "LexicalIndex":
        index = cls(corpus.sparkSession, path or shared_folder(corpus.sparkSession, "lexical-index"))
        index.append(corpus, id_col, text_col)
        return index

    @classmethod
    def open_or_build(cls, corpus: DataFrame, id_col: str, text_col: str) -> "LexicalIndex":
        """The index of the files that ``corpus`` reads, kept in the shared folder under
        their names, sizes and times and the columns' names; built when there is none."""
        spark = corpus.sparkSession
        files = [f for p in sorted(corpus.inputFiles()) for f in listing(spark, p)]
        key = fingerprint([*files, (f"{id_col}\t{text_col}\t{BLOCK_BITS}\t{LAYOUT}", 0, 0)])
        index = cls(spark, shared_folder(spark, "lexical-index", key))
        if not finished(spark, f"{index.path}/ids/batch=0"):
            index._write(corpus, id_col, text_col, 0)
        return index

    def append(self, corpus: DataFrame, id_col: str, text_col: str) -> None:
        """Add texts; only the new ones are read. The batch counts as written once its ids
        are, so one that was cut short is written anew."""
        batch = 0
        while finished(self.spark, f"{self.path}/ids/batch={batch}"):
            batch += 1
        self._write(corpus, id_col, text_col, batch)

    def _write(self, corpus: DataFrame, id_col: str, text_col: str, batch: int) -> None:
        ship(self.spark)
        texts = corpus.select(F.col(id_col).cast("long").alias("context_id"), F.col(text_col).alias("text"))
        blocks = (texts.filter("context_id IS NOT NULL").withColumn("block", F.shiftright("context_id", BLOCK_BITS))
                  .repartition("block").sortWithinPartitions("block").select("block", "context_id", tokens(F.col("text")).alias("toks"))
                  .mapInArrow(_blocks(BLOCK_BITS), "token string, block long, ids array<long>, n int"))
        blocks.write.mode("overwrite").parquet(f"{self.path}/postings/batch={batch}")
        texts.filter("context_id IS NOT NULL").select("context_id").write.mode("overwrite").parquet(f"{self.path}/ids/batch={batch}")

    # ------------------------------------------------------------ reading

    def postings(self) -> DataFrame:
        """``(token, block, n, ids)``, one row per token and block."""
        schema = "token string, block long, ids array<long>, n int, batch int"
        p = self.spark.read.schema(schema).parquet(f"{self.path}/postings")
        if not finished(self.spark, f"{self.path}/ids/batch=1"):
            return p.drop("batch")
        return (p.groupBy("token", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
                .withColumn("n", F.size("ids")))

    def ids(self) -> DataFrame:
        return self.spark.read.schema("context_id long").parquet(f"{self.path}/ids").select("context_id")

    def size(self) -> DataFrame:
        """U4 size: postings, distinct tokens and token bytes (as :func:`.retrieve.index_size`)."""
        per_token = self.postings().groupBy("token").agg(F.sum("n").alias("n"))
        return per_token.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("postings"), F.count(F.lit(1)).cast("bigint").alias("tokens"),
                             F.sum(F.octet_length("token") * F.col("n")).cast("bigint").alias("token_bytes"))

    def _lists(self, words: DataFrame, *columns: str) -> DataFrame:
        """The postings of ``words``; of few words (by count) only these are ever shuffled."""
        wanted = broadcast_if_bounded(words.select("token").distinct(), FEW_WORDS)
        return self.postings().select("token", *columns).join(wanted, "token", "left_semi")

    def _words(self, queries: DataFrame) -> DataFrame:
        """``(query_id, token, place, left_out)`` for the tokens that the index has:
        ``place`` counts from the most frequent one, and the first ``left_out`` places wait."""
        words = queries.select("query_id", F.explode("toks").alias("token"))
        df = self._lists(words, "n").groupBy("token").agg(F.sum("n").alias("df"))
        known = words.join(df, "token")
        w = Window.partitionBy("query_id")
        known = known.withColumn("place", F.row_number().over(w.orderBy(F.desc("df"), "token")))
        waits = (F.col("place") <= F.floor(F.count(F.lit(1)).over(w) * LEFT_OUT)) & (F.col("df") >= LONG_LIST)
        return known.withColumn("left_out", F.sum(waits.cast("int")).over(w)).drop("df")

    def _counted(self, words: DataFrame) -> DataFrame:
        """``(query_id, context_id, shared)`` from the whole lists of ``words``. A list is at
        most one row per block, so Spark's own splitting of skewed joins spreads long ones."""
        words = words.select("query_id", "token")
        hits = self.postings().select("token", "ids").join(broadcast_if_bounded(words, FEW_WORDS), "token")
        return (hits.select("query_id", F.explode("ids").alias("context_id"))
                .groupBy("query_id", "context_id").agg(F.count(F.lit(1)).alias("shared")))

    def _least(self, found: DataFrame, k: int) -> DataFrame:
        """The k-th best count of each query that has so many hits."""
        best = Window.partitionBy("query_id").orderBy(F.desc("shared"))
        return found.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("query_id", F.col("shared").alias("least"))

    def _stages(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The words, each with the number ``skipped`` of its query's longest lists that are
        not read, and the counts over all lists that are."""
        words = materialize(self._words(queries))
        rare = materialize(self._counted(words.filter(F.col("place") > F.col("left_out"))))
        words = materialize(words.join(self._least(rare, k), "query_id", "left")
                            .withColumn("skipped", F.least("left_out", F.coalesce(F.col("least") - 1, F.lit(0)))))
        between = self._counted(words.filter((F.col("place") <= F.col("left_out")) & (F.col("place") > F.col("skipped"))))
        found = rare.unionByName(between).groupBy("query_id", "context_id").agg(F.sum("shared").alias("shared"))
        return words, materialize(found)

    def search(self, queries: DataFrame, query_id: str, query_text: str, k: int = 3) -> DataFrame:
        """The result of :func:`.retrieve.retrieve_lexical` over all indexed texts:
        ``(query_id, rank, context_id, score)``, ties by id. Query ids should be unique."""
        q = materialize(queries.select(F.col(query_id).cast("long").alias("query_id"), tokens(F.col(query_text)).alias("toks"))
                        .dropDuplicates(["query_id"]))
        words, found = self._stages(q, k)
        skipped = words.groupBy("query_id").agg(F.max("skipped").alias("skipped"))
        candidates = (found.join(skipped, "query_id").join(self._least(found, k), "query_id", "left")
                      .filter(F.col("shared") + F.col("skipped") >= F.coalesce("least", F.lit(0))).select("query_id", "context_id", "shared"))
        # candidates of one query in one block: no more than the ids of the block
        near = (candidates.groupBy("query_id", F.shiftright("context_id", BLOCK_BITS).alias("block"))
                .agg(F.collect_list("context_id").alias("wanted")))
        unread = words.filter(F.col("place") <= F.col("skipped")).select("query_id", "token")
        probes = near.join(unread, "query_id")
        more = (self._lists(unread, "block", "ids").join(probes, ["token", "block"])
                .select("query_id", F.explode(F.array_intersect("ids", "wanted")).alias("context_id"))
                .groupBy("query_id", "context_id").agg(F.count(F.lit(1)).alias("shared")))
        shared = candidates.unionByName(more).groupBy("query_id", "context_id").agg(F.sum("shared").alias("shared"))
        scored = (shared.join(q.select("query_id", F.size("toks").alias("n")), "query_id")
                  .select("query_id", "context_id", (F.col("shared") / F.col("n")).alias("score")))
        # texts that share nothing score 0: the k smallest ids stand for them
        first = [r["context_id"] for r in self.ids().distinct().orderBy("context_id").limit(k).collect()]
        none = each_with(q, first).withColumn("score", F.lit(0.0))
        both = scored.unionByName(none).groupBy("query_id", "context_id").agg(F.max("score").alias("score"))
        return _final_top_k(both, k)

    def lists_read(self, queries: DataFrame, query_id: str, query_text: str, k: int = 3) -> DataFrame:
        """What a search reads whole: ``(query_id, tokens, left_out, skipped)``."""
        q = queries.select(F.col(query_id).cast("long").alias("query_id"), tokens(F.col(query_text)).alias("toks")).dropDuplicates(["query_id"])
        words, _ = self._stages(materialize(q), k)
        return words.groupBy("query_id").agg(F.count(F.lit(1)).alias("tokens"), F.max("left_out").alias("left_out"), F.max("skipped").alias("skipped"))
