"""Backward as-of joins and other point-in-time selections.

A join is one union and one window on the key: no range join, no row is multiplied. A key's history
is dealt by slices of time as well, so that one key with a third of all rows is shared by many tasks;
what a slice starts from is carried over in a table of one row a key and slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import SLICE, slice_of


def asof_backward(
    left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str],
    tie: str | None = None, max_age: str | None = None, days: int = SLICE,
) -> DataFrame:
    """``left`` with the ``values`` of the latest right row of its key at or before its time.

    Among rows of one time the largest ``tie`` wins. A match older than ``max_age`` (an interval) is
    no match. ``matched_at`` is its time. Left rows without a match keep nulls.
    """
    own = left.columns
    # A struct of right values marks right rows; left rows carry null there.
    pick = F.struct(F.col(right_time).alias("_t"), *[F.col(v).alias(v) for v in values])
    tied = F.col(tie) if tie else F.lit(0)
    r = right.where(F.col(right_time).isNotNull()).select(F.col(key).alias("_k"), F.col(right_time).alias("_at"), F.lit(0).alias("_side"), tied.alias("_tie"), pick.alias("_r"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in own])
    kind = r.schema["_tie"].dataType
    l = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_tie"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), *[F.col(c) for c in own])
    rows = r.union(l)
    rows = rows.withColumn("_slice", slice_of("_at", days))
    past = Window.partitionBy("_k", "_slice").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The slices' ends come from the right rows alone: a slice without one hands on what it got.
    ends = rows.groupBy("_k", "_slice").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_at", "_tie"))).alias("_end"))
    earlier = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_k", "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    rows = rows.withColumn("_m", F.last("_r", ignorenulls=True).over(past)).where("_side = 1")
    rows = rows.join(carried, ["_k", "_slice"], "left").withColumn("_m", F.coalesce("_m", "_carry"))
    if max_age:
        rows = rows.withColumn("_m", F.when(F.col("_at") - F.expr(f"interval {max_age}") <= F.col("_m._t"), F.col("_m")))
    return rows.select(*own, F.col("_m._t").alias("matched_at"), *[F.col(f"_m.{v}").alias(v) for v in values])


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order of ``order``; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def visible_versions(rows: DataFrame, keys: list[str], happened: str, available: str, cutoff: Column, tie: str) -> DataFrame:
    """Bitemporal selection: facts that happened and were known by ``cutoff``, the newest version of each."""
    return latest_per_key(rows.where((F.col(happened) <= cutoff) & (F.col(available) <= cutoff)), keys, [available, tie])
