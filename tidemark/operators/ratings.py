"""Ratings in periods: all results of a period are rated with the ratings of its start.

Ratings that follow every single match are those of ``waves``. With
periods each step is a join and a sum over players, so a step's work is spread over the cluster and only
the number of periods is sequential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

START, SPREAD = 1500.0, 400.0


def step_size(played: Column) -> Column:
    """How far one result moves a rating: 32 at first, less with matches played, never under 8."""
    return F.greatest(F.lit(8.0), F.lit(32.0 * 15.0) / (15.0 + played))


def expected(rating: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - rating) / SPREAD))


def rate(matches: DataFrame, periods: list) -> DataFrame:
    """Columns player, rating, played after ``periods`` (in order) of matches (period, winner, loser).

    Matches with a missing side or the same player twice do not count. The ratings are a new table
    after each period, so a plan holds one period only.
    """
    ok = matches.where("winner is not null and loser is not null and winner <> loser")
    sides = ok.select("period", F.explode(F.array(
        F.struct(F.col("winner").alias("player"), F.col("loser").alias("other"), F.lit(1.0).alias("won")),
        F.struct(F.col("loser").alias("player"), F.col("winner").alias("other"), F.lit(0.0).alias("won")),
    )).alias("s")).select("period", "s.*")
    # One row a pair and period: the number of rows that meet the ratings does not grow with repeated pairs.
    sides = cut(sides.groupBy("period", "player", "other").agg(F.sum("won").alias("won"), F.count("*").alias("n")), "sides")
    ratings = cut(sides.select("player").distinct().select("player", F.lit(START).alias("rating"), F.lit(0).cast("long").alias("played")), "ratings")
    for period in periods:
        now = sides.where(F.col("period") == F.lit(period))
        others = ratings.select(F.col("player").alias("other"), F.col("rating").alias("other_rating"))
        mine = ratings.select("player", F.col("rating").alias("own"))
        gain = F.col("won") - F.col("n") * expected(F.col("own"), F.col("other_rating"))
        moved = now.join(others, "other").join(mine, "player").groupBy("player").agg(F.sum(gain).alias("gain"), F.sum("n").alias("n"))
        ratings = cut(ratings.join(moved, "player", "left").select(
            "player",
            (F.col("rating") + step_size(F.col("played")) * F.coalesce("gain", F.lit(0.0))).alias("rating"),
            (F.col("played") + F.coalesce("n", F.lit(0))).alias("played"),
        ), "ratings", instead_of=ratings)
    return ratings
