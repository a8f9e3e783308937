"""Folders below the session's shared checkpoint folder, and listings of source files."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str, key: str | None = None) -> str:
    """``name`` with ``key`` (a fresh one by default) in the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/qaspark/{name}-{key or uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read back: cuts the lineage, survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a Spark write into ``path`` was committed."""
    p, fs = _hadoop(spark, path.rstrip("/") + "/_SUCCESS")
    return fs.exists(p)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """The folders directly below ``path``, by name; none if it does not exist."""
    p, fs = _hadoop(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """``(file, bytes, time of change)`` of every file below ``path`` (a file, a folder or a
    glob), by name; hidden files and those of a commit are left out. The listing goes to
    the driver, as that of any Spark read does."""
    root, fs = _hadoop(spark, path)
    out = []
    for status in fs.globStatus(root) or []:
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                out.append((f.getPath().toString(), int(f.getLen()), int(f.getModificationTime())))
    return sorted(out)


def fingerprint(files: list[tuple[str, int, int]]) -> str:
    """Digest of a listing: it changes when a file is added, dropped, resized or rewritten."""
    return hashlib.sha256("\n".join(f"{p}\t{n}\t{t}" for p, n, t in files).encode()).hexdigest()[:32]
