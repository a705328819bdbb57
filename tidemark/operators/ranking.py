"""Ranks and running totals over a whole table in one order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def running_total(rows: DataFrame, order: list[Column | str], value: Column | str, name: str = "before") -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows that come earlier in ``order``.

    The rows are dealt by ranges of the order and written once; each range is summed in itself, and
    only one number a range meets in a window. ``order`` must tell all rows apart.
    """
    dealt = cut(rows.withColumn("_v", F.expr(value) if isinstance(value, str) else value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(F.sum("_v").alias("_sum"))  # one row a range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_own", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return dealt.join(F.broadcast(sums), "_range").withColumn(name, F.col("_base") + F.col("_own")).drop("_range", "_v", "_own", "_base")


def ranked(rows: DataFrame, order: list[Column | str], name: str = "k", total: str | None = None) -> DataFrame:
    """``rows`` with ``name``, their place from 1 in ``order``, and with ``total`` the number of all rows."""
    out = running_total(rows, order, F.lit(1), name).withColumn(name, F.col(name) + 1)
    return out.crossJoin(F.broadcast(rows.agg(F.count("*").alias(total)))) if total else out
