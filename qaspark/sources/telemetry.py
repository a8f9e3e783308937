"""Telemetry records collected as text files.

* GPU power lines ``index, power.draw, power.limit`` (CSV, no header);
* GPU memory lines: one number per line, MB (``memory.free`` or
  ``memory.total``), converted to GB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import mb_to_gb
from ..operators.telemetry import power_utilisation_pct

POWER_SCHEMA = "gpu_index INT, power_draw DOUBLE, power_limit DOUBLE"


def read_power(spark: SparkSession, path: str) -> DataFrame:
    """Power lines → ``(gpu_index, power_draw, power_limit, power_pct)``, one row per
    line; as in :func:`parse_power_lines`, a malformed line gives nulls."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("line"))
    return parse_power_lines(lines).drop("line")


def parse_power_lines(lines: DataFrame, col: str = "line") -> DataFrame:
    """S8 over a column of lines already in a DataFrame (``from_csv``)."""
    p = F.from_csv(F.col(col), POWER_SCHEMA, {"ignoreLeadingWhiteSpace": "true",
                                              "ignoreTrailingWhiteSpace": "true"})
    return lines.select("*", p.alias("p")).select("*", "p.*").drop("p") \
        .withColumn("power_pct", power_utilisation_pct("power_draw", "power_limit"))


def parse_memory_lines(lines: DataFrame, col: str = "line") -> DataFrame:
    """S9 over a column of lines: ``mb`` (null when not a number) and ``gb``."""
    mb = F.trim(F.col(col)).try_cast("double")
    return lines.withColumn("mb", mb).withColumn("gb", mb_to_gb(F.col("mb")))


def read_memory_mb(spark: SparkSession, path: str) -> DataFrame:
    """One MB number per line → ``(line_mb, gb)``; lines that are not a
    number are dropped."""
    df = spark.read.text(path).select(F.trim("value").try_cast("double").alias("mb"))
    return df.filter(F.col("mb").isNotNull()).withColumn("gb", mb_to_gb("mb"))
