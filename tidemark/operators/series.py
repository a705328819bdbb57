"""Windows over ordered histories: trailing features, streaks, gaps, drawdowns, ledgers, sampling.

A history is dealt by its key and by slices of time, so that a key with a third of all rows is shared by
many tasks. What a slice starts from is carried over in a table of one row a key and slice. Rows without
a key or a time are kept; nothing is carried over between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000
#: Days of a slice.
SLICE = 5


def micros(time: str) -> Column:
    return F.expr(f"unix_micros(cast({time} as timestamp))")


def slice_of(time: str, days: int = SLICE) -> Column:
    return F.floor(micros(time) / (days * 86400 * MICROS))


def trailing_features(rows: DataFrame, key: str, time: str, tie: str, value: str, widths: dict[str, int]) -> DataFrame:
    """For each width in seconds, bounds included: change, change a second, sample deviation and count.

    All windows share one sort. The deviation of one value is 0; the change is from the first value
    in the window. Slices are as long as the widest window; each row also stands in the next slice,
    where it is only looked back at.
    """
    rows = with_context(rows, key, time, max(widths.values()))
    for name, seconds in widths.items():
        w = Window.partitionBy(key, "_slice").orderBy("_u").rangeBetween(-seconds * MICROS, 0)
        change = F.col(value) - F.first(value).over(w)
        rows = rows.withColumn(f"delta_{name}", change).withColumn(f"speed_{name}", change / F.lit(float(seconds)))
        rows = rows.withColumn(f"vol_{name}", F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0))).withColumn(f"n_{name}", F.count(value).over(w))
    return rows.where("_own").drop("_u", "_slice", "_own")


def with_context(rows: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """``rows`` with _u (microseconds), _slice and _own: each row once in its slice of ``seconds`` and once, not its own, in the next."""
    rows = rows.withColumn("_u", micros(time)).withColumn("_at", F.floor(F.col("_u") / (seconds * MICROS)))
    return rows.withColumn("_slice", F.explode(F.array("_at", F.col("_at") + 1))).withColumn("_own", F.col("_slice") == F.col("_at")).drop("_at")


def _slices(key: str) -> Window:
    return Window.partitionBy(key).orderBy("_slice")


def previous(rows: DataFrame, key: str, order: list[str], *columns: str, days: int = SLICE) -> DataFrame:
    """``rows`` with _p: a struct of ``columns`` of the row before, null at the first."""
    rows = rows.withColumn("_slice", slice_of(order[0], days)).withColumn("_now", F.struct(*columns))
    ends = rows.groupBy(key, "_slice").agg(F.max_by("_now", F.struct(*order)).alias("_end"))
    carried = ends.select(key, "_slice", F.lag("_end").over(_slices(key)).alias("_carry"))
    rows = rows.withColumn("_p", F.lag("_now").over(Window.partitionBy(key, "_slice").orderBy(*order)))
    return rows.join(carried, [key, "_slice"], "left").withColumn("_p", F.coalesce("_p", "_carry")).drop("_slice", "_now", "_carry")


def last_known(rows: DataFrame, key: str, order: list[str], values: dict[str, Column], current: bool, days: int = SLICE) -> DataFrame:
    """``rows`` with each named value as it was last known before the row, or up to it with ``current``."""
    rows = rows.withColumn("_slice", slice_of(order[0], days))
    for n, v in values.items():
        rows = rows.withColumn(f"_v_{n}", v)
    ends = rows.groupBy(key, "_slice").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_e_{n}") for n in values])
    earlier = _slices(key).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_slice", *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in values])
    w = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    for n in values:
        rows = rows.withColumn(n, F.last(f"_v_{n}", ignorenulls=True).over(w))
    rows = rows.join(carried, [key, "_slice"], "left")
    for n in values:
        rows = rows.withColumn(n, F.coalesce(n, f"_c_{n}"))
    return rows.drop("_slice", *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])


def by_time(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order)


def streaks(rows: DataFrame, key: str, order: list[str], side: str, days: int = SLICE) -> DataFrame:
    """``streak``: how many times in a row ``side`` stands up to each row; a null breaks and is 0."""
    w = Window.partitionBy(key, "_slice").orderBy(*order)
    rows = rows.withColumn("_slice", slice_of(order[0], days))
    rows = rows.withColumn("_new", F.when(F.col(side) == F.lag(side).over(w), 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_run", F.row_number().over(Window.partitionBy(key, "_slice", "_island").orderBy(*order)))
    at = F.struct(*order)
    ends = rows.groupBy(key, "_slice").agg(
        F.min_by(side, at).alias("_first"), F.max_by(side, at).alias("_last"), F.max_by("_run", at).alias("_tail"), F.max("_island").alias("_islands"), F.count("*").alias("_n")
    )
    # A slice goes on with the run before it if it begins with the same side, and hands it on whole if it is one run.
    ends = ends.withColumn("_joins", F.coalesce(F.col("_first") == F.lag("_last").over(_slices(key)), F.lit(False)))
    ends = ends.withColumn("_on", F.col("_joins") & (F.col("_islands") == 1))
    ends = ends.withColumn("_chain", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(_slices(key).rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy(key, "_chain").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_end", F.sum(F.when(F.col("_on"), F.col("_n")).otherwise(F.col("_tail"))).over(chain))
    carried = ends.select(key, "_slice", F.when(F.col("_joins"), F.lag("_end").over(_slices(key))).otherwise(0).alias("_carry"))
    streak = F.col("_run") + F.when(F.col("_island") == 1, F.coalesce("_carry", F.lit(0))).otherwise(0)
    rows = rows.join(carried, [key, "_slice"], "left").withColumn("streak", F.when(F.col(side).isNull(), 0).otherwise(streak).cast("int"))
    return rows.drop("_slice", "_new", "_island", "_run", "_carry")


def confirmations(rows: DataFrame, key: str, order: list[str], side: str, required: int) -> DataFrame:
    """The first row of each key at which the same side has come ``required`` times in a row."""
    rest = [c for c in rows.columns if c != key and c not in order]
    hit = streaks(rows, key, order, side).where(F.col("streak") == required)
    first = hit.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(key, *[F.col(f"_f.{c}").alias(c) for c in (*order, *rest)])


def changes_only(rows: DataFrame, key: str, order: list[str], signature: list[str]) -> DataFrame:
    """Rows whose signature is not that of the row before."""
    return previous(rows, key, order, *signature).where(~F.struct(*signature).eqNullSafe(F.col("_p"))).drop("_p")


def drawdown(rows: DataFrame, key: str, order: list[str], value: str, days: int = SLICE) -> DataFrame:
    """Running equity, its peak and the fall from it, in units and as a share of the peak."""
    w = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_slice", slice_of(order[0], days)).withColumn("_e", F.sum(value).over(w)).withColumn("_q", F.max("_e").over(w))
    ends = rows.groupBy(key, "_slice").agg(F.sum(value).alias("_sum"), F.max("_e").alias("_high"))
    earlier = _slices(key).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    carried = ends.select(key, "_slice", "_base", F.max(F.col("_base") + F.col("_high")).over(earlier).alias("_peak"))
    rows = rows.join(carried, [key, "_slice"], "left").withColumn("equity", F.coalesce("_base", F.lit(0)) + F.col("_e")).withColumn("peak", F.greatest("_peak", F.coalesce("_base", F.lit(0)) + F.col("_q")))
    rows = rows.withColumn("fall", F.col("peak") - F.col("equity")).drop("_slice", "_e", "_q", "_base", "_peak")
    return rows.withColumn("fall_share", F.when(F.col("peak") > 0, F.col("fall") / F.col("peak")).otherwise(0.0))


def ledger(rows: DataFrame, key: str, order: list[str], amount: str, resets: Column, days: int = SLICE) -> DataFrame:
    """Running balance that a resetting entry starts anew from its own amount."""
    w = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_slice", slice_of(order[0], days)).withColumn("_i", F.sum(F.when(resets, 1).otherwise(0)).over(w))
    inside = Window.partitionBy(key, "_slice", "_i").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.sum(amount).over(inside))
    ends = rows.groupBy(key, "_slice").agg(F.max_by("_own", F.struct(*order)).alias("_end"), F.max("_i").alias("_resets"))
    # A slice without a reset adds to the balance before it; one with a reset hands on its own.
    ends = ends.withColumn("_chain", F.sum(F.when(F.col("_resets") > 0, 1).otherwise(0)).over(_slices(key).rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("_balance", F.sum("_end").over(Window.partitionBy(key, "_chain").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)))
    carried = ends.select(key, "_slice", F.coalesce(F.lag("_balance").over(_slices(key)), F.lit(0)).alias("_carry"))
    rows = rows.join(carried, [key, "_slice"], "left").withColumn("balance", F.col("_own") + F.when(F.col("_i") == 0, F.coalesce("_carry", F.lit(0))).otherwise(0))
    return rows.drop("_slice", "_i", "_own", "_carry")


def even_sample(rows: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows of each key at even steps, both ends included; halves round to even."""
    w = by_time(key, *order)
    rows = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    slots = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda s: F.bround(s * (F.col("_n") - 1) / F.lit(limit - 1)).cast("long"))
    return rows.where((F.col("_n") <= limit) | F.array_contains(slots, F.col("_i").cast("long"))).drop("_i", "_n")
