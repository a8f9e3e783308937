"""Make the package importable in the Python workers of a cluster.

Worker functions are pickled by module name, so every executor must be able to
import ``qaspark``. :func:`ship` zips the package's sources once per
SparkContext and hands the archive to ``addPyFile``, which serves it to all
executors (also to those that join later or replace lost ones).
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers (once per SparkContext) and return ``spark``.

    A package that was itself loaded from an archive (``--py-files``) is already
    with the workers and is not sent again.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped or not os.path.isdir(_PACKAGE_DIR):
        return spark
    archive = os.path.join(tempfile.mkdtemp(prefix="qaspark-ship-"), "qaspark_package.zip")
    root = os.path.dirname(_PACKAGE_DIR)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_PACKAGE_DIR):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
    return spark
