"""Spark sessions with the settings this library expects."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g", name: str = "screenpulse") -> SparkSession:
    """A local session; on a cluster, pass the cluster's own session to the library instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=SETTINGS)
    return builder.config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", driver_memory).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers on hosts that hold this checkout import the package; elsewhere it goes by --py-files."""
    root, env = str(Path(__file__).parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark
