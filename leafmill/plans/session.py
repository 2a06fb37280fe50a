"""Session settings that the engine relies on."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; on a cluster the package is installed or shipped with --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{held}".rstrip(":")
    return spark
