"""Reading and writing tables: explicit schemas, content-addressed raw payloads, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; lines that do not parse are kept in ``_bad``."""
    return spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def new_payloads(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each content that is not stored yet, by the SHA-256 of ``payload``."""
    hashed = incoming.withColumn("content_hash", F.sha2(F.col("payload"), 256)).dropDuplicates(["content_hash"])
    return hashed.join(stored.select("content_hash"), "content_hash", "left_anti")


def append_raw(rows: DataFrame, path: str, time: str = "collected_at") -> None:
    """Append to an archive partitioned by day of collection; earlier days are never touched."""
    rows.withColumn("dt", F.to_date(time)).write.mode("append").partitionBy("dt").parquet(path)


def retained(rows: DataFrame, time: str, now: str, days: int) -> DataFrame:
    """Rows young enough to keep; the cutoff is a literal, so partitions are pruned."""
    return rows.where(F.col(time) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))
