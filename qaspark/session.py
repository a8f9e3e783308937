"""Session construction and small execution helpers shared by all operators.

Nothing here schedules work: the helpers only pick Spark settings, resolve the
shared checkpoint folder and guard broadcasts with a proven row bound.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings a job on a large cluster wants; tests reuse them on local[*].
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "qaspark", extra: dict | None = None) -> SparkSession:
    """Return the active session or create one with :data:`DEFAULT_CONF`.

    ``master`` and ``shuffle_partitions`` are only applied when given, so a
    cluster submission keeps whatever the launcher configured.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints.

    On a cluster ``spark.checkpoint.dir`` names a shared (distributed) folder and
    is used as is; a cluster without it is an error. Only for a local master
    with nothing configured -- local runs and tests -- do we give the
    SparkContext a scratch folder of our own (the setting itself is a core
    config and cannot be changed at runtime).
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not configured and not sc.master.startswith("local"):
            # a machine-local folder is not shared by the executors of a cluster
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, object store, ...)")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="qaspark-ckpt-"))
    return configured or sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (survives executor loss).

    Used after the inference hook so that inference never runs twice and a lost
    executor does not re-run the model on recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, max_rows: int) -> int | None:
    """Row count of ``df`` if it is at most ``max_rows``, else ``None``.

    Only ``max_rows + 1`` rows are ever counted, so the probe stays cheap on a
    large input. This is the proof of size required before a broadcast.
    """
    n = df.limit(max_rows + 1).count()
    return n if n <= max_rows else None


def broadcast_if_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only when the row bound is proven; else leave the choice
    to Catalyst/AQE (sort-merge or shuffled hash join)."""
    return F.broadcast(df) if bounded_rows(df, max_rows) is not None else df
