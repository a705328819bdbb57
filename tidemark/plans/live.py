"""Features of live matches as of a cutoff. A user is a match: purchases are cutoffs, clicks quotes and views states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import live
from ..sources.tables import table
from .registry import query

WINDOWS = [6 * 3600, 24 * 3600]


def inputs(spark, sf) -> tuple:
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, n = F.col("k"), lambda x: x.cast("string")
    some = lambda when, *parts: F.when(when, F.concat(*[F.lit(p) if isinstance(p, str) else n(p) for p in parts])).otherwise("")
    detail = F.concat(
        F.lit('{"score_a": '), n(k % 4), F.lit(', "score_b": '), n(F.expr("k div 4 % 4")), some(k % 6 > 0, ', "current_period": ', F.col("event_id") % 5 + 1), some(k % 7 > 0, ', "minute": ', k),
        F.lit(', "yellow_cards": {"team_a": '), n(k % 3), some(k % 5 > 0, ', "team_b": ', k % 2), F.lit("}"), some(k % 9 == 0, ', "red_cards": {"team_b": 1}'), F.lit(', "shots_on_goal": {"team_a": '), n(k % 11),
        F.lit(', "team_b": '), n(k % 8), F.lit("}"), F.lit(', "xg": {"team_a": '), n(k % 30 / 10.0), F.lit("}"), some(k % 4 == 0, ', "powerplay": {"is_active": true, "team": "', F.when(k % 8 == 0, "home").otherwise("2"), '"}'),
        some(k % 13 == 0, ', "empty_net_b": true, "is_penalties": true'), F.lit("}"),
    )
    cutoffs = e.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("event_id").alias("cutoff_id"), F.col("ts").alias("cutoff"))
    outcome = F.get(F.array(*map(F.lit, ("home", "draw", "team_b", "2", "x", "1"))), (F.col("event_id") % 6).cast("int"))
    quotes = e.where("event_type = 'click'").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("rid"), outcome.alias("outcome"), (0.95 + F.col("value") / 100).alias("odds"))
    states = e.where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("rid"), detail.alias("detail"))
    return cutoffs, quotes, states


def _sql(sides: str, state: str) -> str:
    names = {"a": "('home', '1')", "x": "('draw', 'x')", "b": "('team_b', '2')"}
    text = f"""WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events), c0 AS (SELECT user_id, event_id AS cutoff_id, ts FROM e WHERE event_type = 'purchase'),
q AS (SELECT user_id, ts, event_id, ['home', 'draw', 'team_b', '2', 'x', '1'][event_id % 6 + 1] AS outcome, 0.95 + value / 100 AS odds FROM e WHERE event_type = 'click')"""
    at, columns = "c0", []
    for s in sides:
        text += f""",
c_{s} AS (SELECT l.*, CASE WHEN r.odds > 1 THEN r.odds ELSE 0 END AS odds_{s} FROM {at} l ASOF LEFT JOIN (SELECT * FROM q WHERE outcome IN {names[s]}) r ON r.user_id = l.user_id AND l.ts >= r.ts)"""
        at = f"c_{s}"
    for s in ("a", "b"):
        for w in WINDOWS:
            text += f""",
w_{s}_{w} AS (SELECT cutoff_id, arg_min(odds, r.ts) AS f, coalesce(stddev_samp(odds), 0) AS v FROM c0 l JOIN q r ON r.user_id = l.user_id AND r.ts BETWEEN l.ts - INTERVAL {w} SECOND AND l.ts WHERE outcome IN {names[s]} GROUP BY 1),
d_{s}_{w} AS (SELECT l.*, CASE WHEN coalesce(f, odds_{s}) > 0 THEN round(odds_{s} - coalesce(f, odds_{s}), 4) ELSE 0 END AS delta_{s}_{w}, round(coalesce(v, 0), 6) AS volatility_{s}_{w} FROM {at} l LEFT JOIN w_{s}_{w} USING (cutoff_id))"""
            at = f"d_{s}_{w}"
            columns += [f"delta_{s}_{w}", f"volatility_{s}_{w}", f"round(delta_{s}_{w} / {w}, 6) + 0.0 AS velocity_{s}_{w}", f"CASE WHEN delta_{s}_{w} > 0.01 THEN 1.0 WHEN delta_{s}_{w} < -0.01 THEN -1.0 ELSE 0.0 END::DOUBLE AS drift_{s}_{w}"]
    part = lambda s: f"CASE WHEN odds_{s} > 1 THEN 1 / odds_{s} ELSE 0 END"
    total = " + ".join(f"({part(s)})" for s in sides)
    fair = [f"CASE WHEN odds_a > 1 AND odds_b > 1 THEN round(({part(s)}) / ({total}), 4) ELSE {0.0 if s == 'x' else 0.5} END::DOUBLE AS fair_{s}" for s in sides]
    return text + f""",
s AS (SELECT l.*, r.k, r.event_id AS sid FROM {at} l ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') r ON r.user_id = l.user_id AND l.ts >= r.ts),
x AS (SELECT *, coalesce(k % 4, 0)::DOUBLE AS ga, coalesce(k // 4 % 4, 0)::DOUBLE AS gb, CASE WHEN k % 6 > 0 THEN sid % 5 + 1 ELSE 1 END::DOUBLE AS per, coalesce(k % 11, 0)::DOUBLE AS sa, coalesce(k % 8, 0)::DOUBLE AS sb FROM s)
SELECT cutoff_id, {", ".join(f"odds_{s}" for s in sides)}, {", ".join(columns + fair)}, round(CASE WHEN odds_a > 1 AND odds_b > 1 THEN greatest(0, {total} - 1) ELSE 0 END, 4)::DOUBLE AS margin, (NOT (odds_a > 1 AND odds_b > 1))::INT::DOUBLE AS is_missing_odds,
  ga AS score_a, gb AS score_b, ga - gb AS goal_diff, ga + gb AS total_goals, per AS period, sa AS shots_a, sb AS shots_b, sa - sb AS shots_diff, round((sa + 1) / (sa + sb + 2), 4) AS shots_ratio, {state} FROM x"""


_MINUTE = "(CASE WHEN k IS NULL THEN 0 WHEN k % 7 > 0 THEN k WHEN per = 1 THEN 45 ELSE 90 END)::DOUBLE"
_FOOTBALL = f"""{_MINUTE} AS minute, coalesce(k % 3, 0)::DOUBLE AS yellow_cards_a, coalesce(CASE WHEN k % 5 > 0 THEN k % 2 END, 0)::DOUBLE AS yellow_cards_b, coalesce(k % 3, 0)::DOUBLE - coalesce(CASE WHEN k % 5 > 0 THEN k % 2 END, 0)::DOUBLE AS yellow_cards_diff,
  0::DOUBLE AS red_cards_a, coalesce((k % 9 = 0)::INT, 0)::DOUBLE AS red_cards_b, 0 - coalesce((k % 9 = 0)::INT, 0)::DOUBLE AS red_cards_diff, coalesce((k % 9 = 0)::INT, 0)::DOUBLE AS has_red_card, 0::DOUBLE AS corners_a, 0::DOUBLE AS corners_b, 0::DOUBLE AS corners_diff,
  50::DOUBLE AS possession_a, 50::DOUBLE AS possession_b, coalesce(k % 30 / 10.0, 0)::DOUBLE AS xg_a, 0::DOUBLE AS xg_b, coalesce(k % 30 / 10.0, 0)::DOUBLE AS xg_diff, ({_MINUTE} >= 75 AND abs(ga - gb) <= 1)::INT::DOUBLE AS is_clutch, (per >= 2)::INT::DOUBLE AS is_second_half,
  (per = 3)::INT::DOUBLE AS is_extra_time, (per >= 4 OR coalesce(k % 13 = 0, false))::INT::DOUBLE AS is_penalties"""
_HOCKEY = """coalesce((k % 4 = 0)::INT, 0)::DOUBLE AS is_powerplay, coalesce((k % 8 = 0)::INT, 0)::DOUBLE AS powerplay_a, coalesce((k % 8 = 4)::INT, 0)::DOUBLE AS powerplay_b, 0::DOUBLE AS empty_net_a, coalesce((k % 13 = 0)::INT, 0)::DOUBLE AS empty_net_b,
  (per = 4)::INT::DOUBLE AS is_overtime, (per >= 5)::INT::DOUBLE AS is_shootout, (per = 3 AND abs(ga - gb) <= 1)::INT::DOUBLE AS is_clutch"""


@query(_sql("axb", _FOOTBALL))
def u12_football_as_of(spark, sf):
    """Football: three prices, their windows and the latest state at each cutoff, with cards, corners, possession and expected goals."""
    return live.features_as_of(*inputs(spark, sf), ["a", "x", "b"], WINDOWS, live.football())


@query(_sql("ab", _HOCKEY))
def u14_hockey_as_of(spark, sf):
    """Hockey: two prices, their windows and the latest state at each cutoff, with power plays and empty nets."""
    return live.features_as_of(*inputs(spark, sf), ["a", "b"], WINDOWS, live.hockey())
