"""Exact deduplication against a persistent digest index.

The index is a Parquet table, bucketed and sorted by the SHA-256 digest of a text. Its
first row of a digest names the row that stays; every later batch that brings the text
again adds a row with its count. New data is digested, grouped by digest (partial
aggregation first, so a group that holds a third of all rows is a few rows per task before
the shuffle), deduplicated against the index by a sort-merge anti-join and appended to it.
Texts never leave the scan: only digests and ids are shuffled. Segments are merged once
there are many.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, shared_path, stored

SCHEMA = "digest STRING, keep_id BIGINT, group_size BIGINT, first BOOLEAN"
MAX_SEGMENTS = 8               # more are merged into one by the next append


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as lower-case hex."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


class DigestIndex:
    """Digests of all texts seen so far, at ``path`` (a fresh shared folder by default).

    Every :meth:`append` writes one more bucketed and sorted segment below ``path``; a new
    object opened on the same path sees all finished segments. A merge writes one segment
    of the next generation; once that is finished, the older generations no longer count.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or shared_path(spark, "digest-index")).rstrip("/")
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self._tables: dict[str, str] = {}

    def _files(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def segments(self) -> list[str]:
        """Folders of the finished segments of the last generation, in order."""
        folder, fs = self._files()
        if not fs.exists(folder):
            return []
        found = sorted(f.getPath().toString() for f in fs.listStatus(folder) if f.isDirectory())
        done = [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p + "/_SUCCESS"))]
        last = max((self._generation(p) for p in done), default=0)
        return [p for p in done if self._generation(p) == last]

    @staticmethod
    def _generation(path: str) -> int:
        return int(path.rsplit("/", 1)[1].split("-")[1])

    def _table(self, path: str) -> DataFrame:
        """A segment as a bucketed table: a join on the digest does not shuffle it."""
        if path not in self._tables:
            buckets = int(path.rsplit("-b", 1)[1])
            name = f"qaspark_index_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet "
                           f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")
            self._tables[path] = name
        return self.spark.table(self._tables[path])

    def read(self, segments: list[str] | None = None) -> DataFrame:
        """``(digest, keep_id, group_size)`` of every digest, counts added over batches. The
        segments are read as plain files, so that Spark can split what is joined to them."""
        segments = self.segments() if segments is None else segments
        if not segments:
            return self.spark.createDataFrame([], "digest string, keep_id long, group_size long")
        rows = self.spark.read.schema(SCHEMA).parquet(*segments)
        if len(segments) == 1:
            return rows.drop("first")                       # a digest has one row in a segment
        return rows.groupBy("digest").agg(F.max(F.when(F.col("first"), F.col("keep_id"))).alias("keep_id"),
                                          F.sum("group_size").alias("group_size"))

    def missing(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` whose digest is not indexed: a sort-merge anti-join per segment."""
        for path in self.segments():
            groups = groups.join(self._table(path).select("digest").hint("merge"), "digest", "left_anti")
        return groups

    def append(self, groups: DataFrame) -> None:
        """Add ``groups(digest, keep_id, group_size)``, one row per digest: new digests with
        the row that stays, known ones with their count only."""
        if len(self.segments()) >= MAX_SEGMENTS:
            self.merge()
        new = self.missing(groups).withColumn("first", F.lit(True))
        if self.segments():
            known = groups.join(new.select("digest"), "digest", "left_anti")
            new = new.unionByName(known.withColumn("keep_id", F.lit(None).cast("long")).withColumn("first", F.lit(False)))
        segments = self.segments()
        self._write(new, self._generation(segments[0]) if segments else 0, len(segments))

    def merge(self) -> None:
        """Write all segments as one of the next generation, then delete them."""
        old = self.segments()
        self._write(self.read(old).withColumn("first", F.lit(True)), self._generation(old[0]) + 1, 0)
        _, fs = self._files()
        for path in old:
            if path in self._tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(path)}")
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def _write(self, rows: DataFrame, generation: int, number: int) -> None:
        name = f"qaspark_index_{uuid.uuid4().hex}"
        path = f"{self.path}/seg-{generation:06d}-{number:06d}-{uuid.uuid4().hex[:8]}-b{self.buckets}"
        (rows.select("digest", "keep_id", "group_size", "first")
         .repartition(self.buckets, "digest")           # one file per bucket
         .write.bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", path).format("parquet").saveAsTable(name))
        self._tables[self.segments()[-1]] = name

    def close(self) -> None:
        """Drop the session's table names; the files stay."""
        for name in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables.clear()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                index: DigestIndex | None = None, parts: int = 1) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Among equal new texts the row with the largest id stays; a text that the index
    already held stays dropped and ``keep_id`` names the indexed row. ``group_size``
    counts the rows of that text, indexed ones included. A null text counts as empty;
    a null id never stays when its group has another one; repeated rows (same id and
    text) count each, and all of them carry the decision for their id; different texts
    under one id are told apart by their digests. An empty table gives no rows. The index
    is extended by the new digests. With ``parts`` the rows are fed in so many parts by
    falling id (null ids last), each deduplicated against the earlier ones; the result is
    the same. Texts are only digested, whatever their length; other columns are not read.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    rows = stored(prepared(docs, id_col, text_col).select("doc_id", text_digest(F.col("text")).alias("digest")), "digests")
    before = index.segments()
    known = stored(index.read(before).select("digest", F.lit(True).alias("known")), "known-digests") if before else None
    cuts = []
    if parts > 1:
        cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)])).first()[0] or []), reverse=True)
    for top, low in zip([None, *cuts], [*cuts, None]):
        part = rows
        if top is not None:
            part = part.filter((F.col("doc_id") <= top) | F.col("doc_id").isNull()) if low is None else part.filter(F.col("doc_id") <= top)
        if low is not None:
            part = part.filter(F.col("doc_id") > low)
        index.append(part.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    stays = index.read()
    if known is not None:
        stays = stays.join(known, "digest", "left").withColumn("fresh", F.col("known").isNull())
    else:
        stays = stays.withColumn("fresh", F.lit(True))
    return (rows.join(stays.hint("merge"), "digest")
            .select("doc_id", "keep_id", "group_size",
                    (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
                    F.col("digest").alias("text_sha256")))
