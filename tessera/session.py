"""Spark sessions with the settings that the queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; what is None is left to the cluster's own settings."""
    b = SparkSession.builder.appName("tessera")
    for key, value in (("spark.master", master), ("spark.sql.shuffle.partitions", shuffle_partitions), ("spark.driver.memory", memory)):
        if value is not None:
            b = b.config(key, str(value))
    for key, value in (
        ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.coalescePartitions.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
        ("spark.sql.execution.arrow.pyspark.enabled", "true"),
        ("spark.ui.enabled", "false"),
        ("spark.ui.showConsoleProgress", "false"),
    ):
        b = b.config(key, value)
    return b.getOrCreate()
