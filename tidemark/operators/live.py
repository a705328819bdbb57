"""Features of live matches as of a cutoff: the prices and the state that stood then, and nothing later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_backward
from .series import MICROS, with_context

#: A move of the line that counts, and what a side is called.
DRIFT = 0.01
SIDES = {"a": ["team_a", "1", "home", "player_a"], "x": ["draw", "x", "X"], "b": ["team_b", "2", "away", "player_b"]}
_TEAMS = "struct<team_a: double, team_b: double>"
#: What is read of a state's detail; anything may be missing.
DETAIL = (
    "score_a double, score_b double, current_period double, minute double, " + ", ".join(f"{c} {_TEAMS}" for c in ("yellow_cards", "red_cards", "corners", "shots_on_goal", "possession_pct", "xg"))
    + ", is_extra_time boolean, is_penalties boolean, is_overtime boolean, is_shootout boolean, empty_net_a boolean, empty_net_b boolean, powerplay struct<is_active: boolean, team: string>"
)


def side_of(outcome: Column) -> Column:
    out = None
    for side, names in SIDES.items():
        out = F.when(outcome.isin(names), side) if out is None else out.when(outcome.isin(names), side)
    return out


def prices_as_of(cutoffs: DataFrame, quotes: DataFrame, sides: list[str], windows: list[int], moving: list[str]) -> DataFrame:
    """``cutoffs`` (key, cutoff_id, cutoff) with odds_<side>, and for the sides that move and each window delta, velocity, volatility and drift.

    ``quotes``: key, at, rid, outcome, odds. The last quote of a side at or before the cutoff counts; if
    it is 1 or less the side has no price, 0. A window's change is from its first quote, from the last
    price where it has none, and 0 where either is missing; the deviation of fewer than two is 0.
    """
    quotes = quotes.withColumn("side", side_of(F.col("outcome"))).where("side is not null and at is not null")
    out = cutoffs
    for side in sides:
        own = quotes.where(F.col("side") == side)
        out = asof_backward(out, own.withColumnRenamed("odds", f"odds_{side}"), "key", "cutoff", "at", [f"odds_{side}"], tie="rid").drop("matched_at")
        price = F.coalesce(F.when(F.col(f"odds_{side}") > 1, F.col(f"odds_{side}")), F.lit(0.0))
        out = out.withColumn(f"odds_{side}", price)
        if side in moving:
            out = _windows(out, own, side, windows)
    return out


def _windows(out: DataFrame, quotes: DataFrame, side: str, windows: list[int]) -> DataFrame:
    """One union of quotes and cutoffs in slices of the widest window, so a busy key is shared out; a row a cutoff comes back."""
    none = lambda kind: F.lit(None).cast(kind)
    id_kind = out.schema["cutoff_id"].dataType
    marks = out.select("key", F.col("cutoff").alias("at"), none("double").alias("odds"), "cutoff_id")
    rows = with_context(quotes.select("key", "at", F.col("odds").cast("double").alias("odds"), none(id_kind).alias("cutoff_id")).union(marks), "key", "at", max(windows))
    # Quotes of the cutoff's own time count; of equal times the first is the smallest.
    for w in windows:
        over = Window.partitionBy("key", "_slice").orderBy("_u").rangeBetween(-w * MICROS, 0)
        rows = rows.withColumn(f"_first_{w}", F.min(F.when(F.col("odds").isNotNull(), F.struct("_u", "odds"))).over(over)["odds"])
        rows = rows.withColumn(f"_vol_{w}", F.coalesce(F.stddev_samp("odds").over(over), F.lit(0.0)))
    found = rows.where("_own and cutoff_id is not null").select("cutoff_id", *[f"_{c}_{w}" for w in windows for c in ("first", "vol")])
    out = out.join(found, "cutoff_id", "left")
    for w in windows:
        past = F.coalesce(f"_first_{w}", F.col(f"odds_{side}"))
        delta = F.when(past > 0, F.round(F.col(f"odds_{side}") - past, 4)).otherwise(0.0)
        out = out.withColumn(f"delta_{side}_{w}", delta)
        d = F.col(f"delta_{side}_{w}")
        out = out.withColumns({
            f"velocity_{side}_{w}": F.round(d / w, 6), f"volatility_{side}_{w}": F.round(F.coalesce(f"_vol_{w}", F.lit(0.0)), 6), f"drift_{side}_{w}": F.when(d > DRIFT, 1.0).when(d < -DRIFT, -1.0).otherwise(0.0),
        }).drop(f"_first_{w}", f"_vol_{w}")
    return out


def fair_shares(sides: list[str]) -> dict[str, Column]:
    """fair_<side> and margin of odds_<side>: even shares and no margin unless both teams have a price; a missing draw adds nothing."""
    part = {s: F.when(F.col(f"odds_{s}") > 1, 1 / F.col(f"odds_{s}")).otherwise(0.0) for s in sides}
    total = sum(part.values(), F.lit(0.0))
    ok = (F.col("odds_a") > 1) & (F.col("odds_b") > 1)
    out = {f"fair_{s}": F.when(ok, F.round(part[s] / total, 4)).otherwise(0.0 if s == "x" else 0.5) for s in sides}
    return out | {"margin": F.round(F.when(ok, F.greatest(F.lit(0.0), total - 1)).otherwise(0.0), 4), "is_missing_odds": (~ok).cast("double")}


def _team(field: str, side: str, empty: float = 0.0) -> Column:
    return F.coalesce(F.col(f"d.{field}.team_{side}"), F.lit(empty))


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("double")


def _score() -> dict[str, Column]:
    a, b = F.coalesce("d.score_a", F.lit(0.0)), F.coalesce("d.score_b", F.lit(0.0))
    shots = [_team("shots_on_goal", s) for s in "ab"]
    return {
        "score_a": a, "score_b": b, "goal_diff": a - b, "total_goals": a + b, "period": F.coalesce("d.current_period", F.lit(1.0)), "shots_a": shots[0], "shots_b": shots[1], "shots_diff": shots[0] - shots[1],
        "shots_ratio": F.round((shots[0] + 1) / (shots[0] + shots[1] + 2), 4),
    }


def football() -> dict[str, Column]:
    """Features of a football state ``d``; without a state those of a match that has not begun."""
    s = _score()
    minute = F.coalesce("d.minute", F.when(F.col("d").isNull(), 0.0).when(s["period"] == 1, 45.0).otherwise(90.0))
    out = s | {"minute": minute}
    for c in ("yellow_cards", "red_cards", "corners"):
        out |= {f"{c}_a": _team(c, "a"), f"{c}_b": _team(c, "b"), f"{c}_diff": _team(c, "a") - _team(c, "b")}
    return out | {
        "has_red_card": ((_team("red_cards", "a") > 0) | (_team("red_cards", "b") > 0)).cast("double"), "possession_a": _team("possession_pct", "a", 50.0), "possession_b": _team("possession_pct", "b", 50.0),
        "xg_a": _team("xg", "a"), "xg_b": _team("xg", "b"), "xg_diff": F.round(_team("xg", "a") - _team("xg", "b"), 4), "is_clutch": ((minute >= 75) & (F.abs(s["goal_diff"]) <= 1)).cast("double"),
        "is_second_half": (s["period"] >= 2).cast("double"), "is_extra_time": _yes((s["period"] == 3) | F.coalesce("d.is_extra_time", F.lit(False))), "is_penalties": _yes((s["period"] >= 4) | F.coalesce("d.is_penalties", F.lit(False))),
    }


def hockey() -> dict[str, Column]:
    """Features of a hockey state ``d``."""
    s = _score()
    active, team = F.coalesce("d.powerplay.is_active", F.lit(False)), F.col("d.powerplay.team")
    return s | {
        "is_powerplay": active.cast("double"), "powerplay_a": _yes(active & team.isin("team_a", "home", "1")), "powerplay_b": _yes(active & team.isin("team_b", "away", "2")),
        "empty_net_a": _yes(F.col("d.empty_net_a")), "empty_net_b": _yes(F.col("d.empty_net_b")), "is_overtime": _yes((s["period"] == 4) | F.coalesce("d.is_overtime", F.lit(False))),
        "is_shootout": _yes((s["period"] >= 5) | F.coalesce("d.is_shootout", F.lit(False))), "is_clutch": ((s["period"] == 3) & (F.abs(s["goal_diff"]) <= 1)).cast("double"),
    }


def features_as_of(cutoffs: DataFrame, quotes: DataFrame, states: DataFrame, sides: list[str], windows: list[int], state_features: dict[str, Column]) -> DataFrame:
    """cutoff_id, the prices' features and those of the latest state (key, at, rid, detail as JSON) at or before the cutoff.

    Details that are no JSON count as states without a detail. Cutoffs must have ids of their own.
    """
    rows = prices_as_of(cutoffs.select("key", "cutoff_id", "cutoff"), quotes, sides, windows, ["a", "b"])
    rows = asof_backward(rows, states, "key", "cutoff", "at", ["detail"], tie="rid")
    rows = rows.withColumn("d", F.when(F.col("matched_at").isNotNull(), F.coalesce(F.from_json("detail", DETAIL), F.from_json(F.lit("{}"), DETAIL))))
    keep = [c for c in rows.columns if c.startswith(("odds_", "delta_", "velocity_", "volatility_", "drift_"))]
    shares = fair_shares(sides)
    return rows.select("cutoff_id", *keep, *[v.alias(n) for n, v in shares.items()], *[v.alias(n) for n, v in state_features.items()])
