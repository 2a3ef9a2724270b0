"""A session with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tabulon", cores: int | None = None, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """UTC, adaptive execution, Arrow transfer.  cores: a local master; None leaves the master to spark-submit."""
    builder = SparkSession.builder.appName(name)
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
