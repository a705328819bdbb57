"""Probability metrics: calibration, loss, ranking and drift. Inputs: columns p (probability) and y (0/1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running_total


def scores(rows: DataFrame, *by: str) -> DataFrame:
    """Log loss (clipped), Brier score, accuracy at one half and count for each group."""
    p = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(-F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
        F.avg(F.when((F.col("p") >= 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0)).alias("accuracy"),
    )


def calibration_bins(rows: DataFrame, bins: int, by: list[str] | None = None) -> DataFrame:
    """Count, mean probability and observed rate of equal bins, the last closed on the right; empty bins too."""
    by = by or []
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    found = rows.groupBy(*by, b).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    every = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(found, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ece(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over half-open bins: a probability of exactly 1 is in none."""
    b = F.floor(F.col("p") * bins).cast("int")
    binned = rows.where("p < 1").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    total = rows.agg(F.count("*").alias("total"))
    return binned.crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") * F.col("gap") / F.col("total")).alias("ece"))


def auc(rows: DataFrame) -> DataFrame:
    """Area under the curve from counts at each distinct score; one half if a class is missing.

    Scores are counted first, and the running count goes over ranges of distinct values.
    """
    at = rows.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    total = running_total(at, ["p"], "neg", "below").withColumn("u", F.col("pos") * (F.col("below") + F.col("neg") / 2)).agg(F.sum("u").alias("u"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return total.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("u") / (F.col("pos") * F.col("neg"))).otherwise(0.5).alias("auc"))


def psi(rows: DataFrame, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability of p between rows with ``current`` false and true, over equal bins."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    n = rows.groupBy(b.alias("bin")).agg(F.count_if(~F.col("current")).alias("a"), F.count_if("current").alias("b"))
    total = rows.agg(F.count_if(~F.col("current")).alias("ta"), F.count_if("current").alias("tb"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").crossJoin(F.broadcast(total))
    share = lambda x, t: F.greatest(F.coalesce(x, F.lit(0)) / t, F.lit(floor))
    pa, pb = share(F.col("a"), F.col("ta")), share(F.col("b"), F.col("tb"))
    return every.agg(F.sum((pb - pa) * F.ln(pb / pa)).alias("psi"))
