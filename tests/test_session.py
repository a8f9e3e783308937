"""Session helpers: the configured checkpoint folder wins; broadcast bounds."""

from qaspark.session import bounded_rows, broadcast_if_bounded, ensure_checkpoint_dir


def test_configured_checkpoint_dir_is_used(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    got = ensure_checkpoint_dir(spark)
    if configured:
        assert got == configured                      # the shared folder named by the cluster
    assert spark.sparkContext.getCheckpointDir() is not None


def test_unset_checkpoint_dir_gets_scratch_folder(tmp_path):
    """A fresh context without the setting: the helper must not try to change
    the (static) config, only give the context a folder."""
    import subprocess
    import sys
    code = ("from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "assert s.sparkContext.getConf().get('spark.checkpoint.dir', None) is None\n"
            "from qaspark.session import ensure_checkpoint_dir\n"
            "d = ensure_checkpoint_dir(s)\n"
            "print('DIR', d, s.sparkContext.getCheckpointDir() is not None)\n")
    import os
    conf_dir = tmp_path / "empty-conf"                 # no spark-defaults.conf: the setting is unset
    conf_dir.mkdir()
    env = dict(os.environ, SPARK_CONF_DIR=str(conf_dir))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=env,
                         cwd=str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    assert "DIR" in out.stdout and out.stdout.strip().endswith("True"), out.stderr[-2000:]


def test_bounded_rows(spark):
    df = spark.range(50)
    assert bounded_rows(df, 50) == 50 and bounded_rows(df, 49) is None
    assert "strategy=broadcast" in broadcast_if_bounded(df, 100)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in broadcast_if_bounded(df, 10)._jdf.queryExecution().analyzed().toString().lower()
