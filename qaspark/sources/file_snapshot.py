"""Snapshot of a source folder by the fingerprint of its files (S3).

Every run lists the source (path, size, time of change) and parses only files that no
finished earlier run holds in that very state; a file that changed, came or went is
noticed without any key from the caller, so a stale snapshot cannot be read. A run is a
folder of its own: ``items`` (Parquet, one folder per file) and ``files``, the listing it
covers, written last; a run without finished ``files`` is not read, so a run that died
leaves nothing behind but files to delete. Many runs are merged into one.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import delete_folder, fingerprint, finished, folders_in, listing
from .qa_jsonl import ITEM_SCHEMA, parse_items, read_lines

FILES_SCHEMA = "file string, bytes bigint, changed bigint, source_key string"
MERGE_RUNS = 16                # as many runs are written as one


def _decoded(path: Column) -> Column:
    """A file name as a listing gives it: Spark reports it percent-encoded."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _key(file: tuple[str, int, int]) -> str:
    return "f" + fingerprint([file])


class FileSnapshot:
    """Parsed items of the JSON Lines files below ``source``, kept below ``path``."""

    def __init__(self, spark: SparkSession, source: str, path: str, strict: bool = True):
        self.spark, self.source, self.path, self.strict = spark, source, path.rstrip("/"), strict
        self.parsed: list[str] = []         # files that the last read had to parse

    def _runs(self) -> dict[str, DataFrame]:
        return {r: self.spark.read.schema(FILES_SCHEMA).parquet(f"{r}/files")
                for r in folders_in(self.spark, self.path) if finished(self.spark, f"{r}/files")}

    def _held(self) -> dict[str, str]:
        """The run that holds each file state; listings are as small as that of a read."""
        return {row["source_key"]: run for run, files in self._runs().items() for row in files.select("source_key").collect()}

    def _items(self, by_run: dict[str, list[str]]) -> DataFrame:
        """Items with their ``source_key``, of the given file states only."""
        out = self.spark.createDataFrame([], ITEM_SCHEMA + ", source_key string")
        for run, keys in by_run.items():
            wanted = self.spark.createDataFrame([(k,) for k in keys], "source_key string")
            items = self.spark.read.schema(ITEM_SCHEMA + ", source_key string").parquet(f"{run}/items")
            out = out.unionByName(items.join(wanted, "source_key", "left_semi"))
        return out

    def _write(self, items: DataFrame, files: list[tuple[str, int, int]]) -> str:
        run = f"{self.path}/run-{uuid.uuid4().hex}"
        items.write.partitionBy("source_key").parquet(f"{run}/items")
        self.spark.createDataFrame([(*f, _key(f)) for f in files], FILES_SCHEMA).coalesce(1).write.parquet(f"{run}/files")
        return run

    def read(self) -> DataFrame:
        """All items of the source as it is now. A source without files gives no rows; a
        missing one fails, as a read of it does. Strict parsing fails at a malformed line
        and keeps nothing of that run."""
        files = listing(self.spark, self.source)
        if not files:
            return read_items(self.spark, self.source, self.strict)
        held = self._held()
        new = [f for f in files if _key(f) not in held]
        self.parsed = [f[0] for f in new]
        if new:
            lookup = self.spark.createDataFrame([(f[0], _key(f)) for f in new], "file string, source_key string")
            literal = [re.sub(r"([\\[\]{}*?\\\\])", r"\\\1", f[0]) for f in new]      # a reader takes names for patterns
            items = read_items(self.spark, literal, self.strict)
            keyed = items.withColumn("file", _decoded(F.col("ordinal.file"))).join(lookup, "file").drop("file")
            run = self._write(keyed, new)
            held.update({_key(f): run for f in new})
        by_run: dict[str, list[str]] = {}
        for f in files:
            by_run.setdefault(held[_key(f)], []).append(_key(f))
        if len(self._runs()) > MERGE_RUNS:
            old = folders_in(self.spark, self.path)
            merged = self._write(self._items(by_run), files)
            by_run = {merged: [_key(f) for f in files]}
            for run in old:
                delete_folder(self.spark, run)
        return self._items(by_run).drop("source_key")


def read_items(spark: SparkSession, path: str | list[str], strict: bool) -> DataFrame:
    return parse_items(read_lines(spark, path), strict)[0]
