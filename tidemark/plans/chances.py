"""Chances from scores, and ratings in periods. Players are the customers of ``events``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import chances as C
from ..operators.ratings import rate
from ..sources.tables import table
from .registry import query


def _game_sql() -> str:
    out = "CASE WHEN a >= 3 AND b >= 3 THEN CASE a - b WHEN 0 THEN d WHEN 1 THEN p + q * d WHEN -1 THEN p * d ELSE CASE WHEN a > b THEN 1 ELSE 0 END END"
    for x in range(4):
        for y in range(4):
            if x < 3 or y < 3:
                even = f"{math.comb(6 - x - y, 3 - x)} * pow(p, {3 - x}) * pow(q, {3 - y}) * d"
                out += f" WHEN a = {x} AND b = {y} THEN {even}" + "".join(f" + {math.comb(3 - x + k, k)} * pow(p, {4 - x}) * pow(q, {k})" for k in range(3 - y))
    return out + " END"


@query(f"""
WITH s AS (SELECT o_orderkey, o_orderkey % 5 AS a, o_custkey % 5 AS b, 0.5 + (o_orderkey % 40) / 100.0::DOUBLE AS p FROM orders), t AS (SELECT *, 1 - p AS q, p * p / (p * p + (1 - p) * (1 - p)) AS d FROM s)
SELECT o_orderkey, CAST({_game_sql()} AS DOUBLE) AS win FROM t WHERE (a < 4 OR b >= 3) AND (b < 4 OR a >= 3)
""")
def sc40_game_win(spark, sf):
    """The server's chance of the game, a closed form in each score."""
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("a"), (F.col("o_custkey") % 5).alias("b"), (0.5 + (F.col("o_orderkey") % 40) / 100.0).alias("p"))
    rows = rows.where("(a < 4 or b >= 3) and (b < 4 or a >= 3)")
    return rows.select("o_orderkey", C.game_win(F.col("a"), F.col("b"), F.col("p")).alias("win"))


def _served(spark, sf):
    share = lambda c: 0.55 + (F.col(c) % 20) / 100.0
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", share("o_orderkey").alias("p_a"), share("o_custkey").alias("p_b"))


@query()
def sc41_tiebreak_win(spark, sf):
    rows = _served(spark, sf)
    a, b = (F.col("o_orderkey") % 6).cast("int"), (F.col("o_custkey") % 6).cast("int")
    return rows.select("o_orderkey", C.tiebreak_win(a, b, F.col("p_a"), F.col("p_b"), F.col("o_orderkey") % 2 == 0).alias("win"))


@query()
def sc42_match_win(spark, sf):
    """The chance of the match from sets, games and points."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = lambda x, m, name: (x % m).cast("int").alias(name)
    server = F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").otherwise("")
    score = F.struct(
        n(k, 2, "sets_a"), n(c, 2, "sets_b"), n(k, 6, "games_a"), n(c, 6, "games_b"), n(k, 4, "points_a"), n(c, 4, "points_b"),
        "p_a", "p_b", server.alias("server"), (2 + k % 2).cast("int").alias("need"),
    )
    return _served(spark, sf).select("o_orderkey", C.match_win(score).alias("win"))


@query()
def sc43_serve_shares(spark, sf):
    """Serve-point shares of both sides that give a match chance."""
    e = table(spark, sf, "events").select("event_id", (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("p"), (2 + F.col("event_id") % 2).cast("int").alias("need"))
    got = e.select("event_id", C.serve_shares(F.col("p"), F.col("need")).alias("s"))
    return got.select("event_id", F.col("s")[0].alias("share_a"), F.col("s")[1].alias("share_b"))


WEEKS = [0, 1, 2, 3, 4]


def _rating_sql() -> str:
    sql = """WITH m AS (SELECT date_diff('day', DATE '2024-01-01', ts) // 7 AS period, user_id AS w, (user_id * 7 + event_id) % 150 AS l FROM events),
s AS (SELECT period, w AS player, l AS other, 1.0::DOUBLE AS won FROM m WHERE w <> l UNION ALL SELECT period, l, w, 0 FROM m WHERE w <> l),
g AS (SELECT period, player, other, sum(won) AS won, count(*) AS n FROM s GROUP BY ALL), r0 AS (SELECT DISTINCT player, 1500.0::DOUBLE AS rating, 0 AS played FROM g)"""
    for i in WEEKS:
        sql += f""",
d{i} AS (SELECT g.player, sum(g.won - g.n * (1 / (1 + pow(10, (o.rating - me.rating) / 400)))) AS gain, sum(g.n) AS n FROM g JOIN r{i} o ON o.player = g.other JOIN r{i} me ON me.player = g.player WHERE g.period = {i} GROUP BY 1),
r{i + 1} AS (SELECT r.player, r.rating + greatest(8, 480 / (15 + r.played)::DOUBLE) * coalesce(d.gain, 0) AS rating, r.played + coalesce(d.n, 0) AS played FROM r{i} r LEFT JOIN d{i} d USING (player))"""
    return sql + f" SELECT player, round(rating, 6) AS rating, CAST(played AS BIGINT) AS played FROM r{len(WEEKS)}"


@query(_rating_sql())
def ag29_ratings(spark, sf):
    """Ratings after five weeks of results."""
    e = table(spark, sf, "events")
    matches = e.select(F.floor(F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("int").alias("period"), F.col("user_id").alias("winner"), ((F.col("user_id") * 7 + F.col("event_id")) % 150).alias("loser"))
    return rate(matches, WEEKS).withColumn("rating", F.round("rating", 6))
