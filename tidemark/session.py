"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; ``more`` adds settings with _ for dots."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false")
    for k, v in more.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
