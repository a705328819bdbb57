"""Running totals and resampling over histories of any length.

A history is dealt by blocks (such as days); each block gives a few numbers, and only blocks meet in a window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def total_and_drawdown(rows: DataFrame, key: str, block: str, order: list[str], value: str) -> DataFrame:
    """``total`` and ``max_drawdown`` of each key: the deepest fall of the running total from its peak, which starts at 0.

    ``block`` must follow the order: no row of a later block comes before one of an earlier block.
    """
    inside = Window.partitionBy(key, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(key, block, *[c for c in order if c not in (key, block)], F.coalesce(value, F.lit(0.0)).alias("_v"))
    rows = rows.withColumn("_p", F.sum("_v").over(inside)).withColumn("_q", F.max("_p").over(inside))
    blocks = rows.groupBy(key, block).agg(F.sum("_v").alias("_sum"), F.min("_p").alias("_low"), F.max("_p").alias("_high"), F.max(F.col("_q") - F.col("_p")).alias("_fall"))
    before = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    blocks = blocks.withColumn("_peak", F.greatest(F.lit(0.0), F.max(F.col("_base") + F.col("_high")).over(before)))
    fall = F.greatest(F.lit(0.0), F.col("_fall"), F.col("_peak") - F.col("_base") - F.col("_low"))
    return blocks.groupBy(key).agg(F.sum("_sum").alias("total"), F.max(fall).alias("max_drawdown"))


def _uniform(ids: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """One number in [0, 1) for each id and draw, from a 64-bit mixing function."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / 2**53


#: Poisson(1) by its distribution function; beyond 12 the rest is under 1e-9.
_STEPS = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 13)]))


def bootstrap_mean(rows: DataFrame, key: str, value: str, draws: int = 400, seed: int = 42) -> DataFrame:
    """One row: mean, low and high (2.5 and 97.5 %) of the mean over resamples.

    Each resample counts a row a Poisson(1) number of times that hangs on the row's key (a whole number), the
    draw and the seed alone, so the result does not change with the partitions. A task gives ``draws`` pairs of sums.
    Null values do not count; without values all three are null.
    """

    def sums(batches):
        weight, total = np.zeros(draws), np.zeros(draws)
        for b in batches:
            for i in range(0, len(b), 4096):
                part = b.iloc[i : i + 4096]
                w = np.searchsorted(_STEPS, _uniform(part["k"].to_numpy(), draws, seed), side="right")
                weight += w.sum(axis=0)
                total += part["v"].to_numpy(float) @ w
        yield pd.DataFrame({"draw": np.arange(draws), "w": weight, "t": total})

    known = rows.select(F.col(key).cast("long").alias("k"), F.col(value).cast("double").alias("v")).where("k is not null and v is not null")
    drawn = known.mapInPandas(sums, "draw int, w double, t double").groupBy("draw").agg(F.sum("w").alias("w"), F.sum("t").alias("t"))
    means = drawn.where("w > 0").select((F.col("t") / F.col("w")).alias("m"))
    bounds = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))  # of ``draws`` numbers
    return known.agg(F.avg("v").alias("mean")).join(F.broadcast(bounds))
