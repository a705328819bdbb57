"""Drawdowns over blocks against a plain loop; resampled intervals against theory and other partitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.equity import bootstrap_mean, total_and_drawdown


def test_drawdown_equals_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(k, i // 7, i, None if i % 11 == 3 else float(rng.randint(-9, 9))) for k in "ab" for i in range(100)] + [("up", 0, 1, 2.0), ("down", 0, 1, -3.0), ("none", 0, 1, None)]
    got = {r.k: (r.total, r.max_drawdown) for r in total_and_drawdown(spark.createDataFrame(rows, "k string, b int, i int, v double"), "k", "b", ["i"], "v").collect()}
    for key in ("a", "b", "up", "down", "none"):
        total = peak = fall = 0.0
        for k, _, _, v in rows:
            if k == key:
                total += v or 0.0
                peak = max(peak, total)
                fall = max(fall, peak - total)
        assert got[key] == (total, fall)


def test_bootstrap(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 100).cast("double").alias("v"))
    a = bootstrap_mean(rows.repartition(3), "id", "v").collect()[0]
    b = bootstrap_mean(rows.repartition(8), "id", "v").collect()[0]
    assert tuple(a) == pytest.approx(tuple(b), abs=1e-9)
    assert a.mean == pytest.approx(49.5)
    half = 1.96 * math.sqrt((100**2 - 1) / 12 / 5000)
    assert a.low == pytest.approx(49.5 - half, abs=0.25) and a.high == pytest.approx(49.5 + half, abs=0.25)
    assert tuple(bootstrap_mean(rows.where("false"), "id", "v").collect()[0]) == (None, None, None)
