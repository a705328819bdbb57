"""Ratings, calibrators, trained models and walk-forward tests over ``events``; tests hold them against plain recomputation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prices as P
from ..operators import boosting, glicko, metrics, profiles, registry, waves
from ..operators import models as M
from ..operators.ranking import ranked
from ..sources.shared import cut, new_path
from ..sources.tables import table
from .folds import walk_forward
from .registry import query

FEATURES = ["value", "k", "hour"]


def samples(spark, sf) -> DataFrame:
    """event_id, ts, the features, odds, a rough forecast p and the outcome y."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value", k.cast("double").alias("k"), F.hour("ts").cast("double").alias("hour"), (1 + F.col("value") / 100).alias("odds"))
    noise = (F.col("event_id") * 7919 % 101) / 101
    return e.withColumn("p", F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("k") / 100))).withColumn("y", ((F.col("k") / 100 + F.col("value") / 1000 + noise) > 1.1).cast("int"))


_MATCHES = "SELECT event_id, user_id AS w, (user_id * 7 + event_id) % 150 AS l, event_type AS surface, ts FROM events"


def results(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return e.select(F.floor(day / 7).cast("int").alias("period"), F.col("user_id").alias("winner"), ((F.col("user_id") * 7 + F.col("event_id")) % 150).alias("loser"), "event_id", "ts", F.col("event_type").alias("surface"))


@query()
def u2_glicko_update(spark, sf):
    """One Glicko-2 update a row: own and other rating and deviation, and the score."""
    g = glicko.damped(F.lit(1.0) + F.col("hour") / 24)
    e = 1 / (1 + F.exp(-g * (F.col("k") / 50 - 1)))
    rows = samples(spark, sf).select("event_id", (F.col("k") / 50 - 1).alias("mu"), (F.col("value") / 400 + 0.3).alias("phi"), F.lit(0.06).alias("sigma"), (g * g * e * (1 - e)).alias("information"), (g * (F.col("y") - e)).alias("surprise"))
    return rows.select("event_id", glicko.update_column("mu", "phi", "sigma", "information", "surprise").alias("u")).select("event_id", "u.*")


@query()
def u3_period_ratings(spark, sf):
    """Glicko-2 ratings after five weeks of results."""
    out = glicko.rate(results(spark, sf), [0, 1, 2, 3, 4])
    return out.select("player", (1500 + F.col("mu") * glicko.SCALE).alias("rating"), (F.col("phi") * glicko.SCALE).alias("deviation"), "sigma", "played")


@query()
def ag28_player_folds(spark, sf):
    """Each player's state after the last result, folded in order against a neutral opponent."""
    s = samples(spark, sf)
    return glicko.player_folds(s.select(F.col("user_id").alias("player"), F.col("ts").alias("at"), F.col("event_id").alias("result"), F.col("y").alias("won")))


_RESULTS = """SELECT user_id AS player, ts AS t, event_id AS result, CAST(k / 100.0 + value / 1000 + (event_id * 7919 % 101) / 101.0 > 1.1 AS BIGINT) AS w, event_type AS surface, ['atp', 'challenger', 'itf'][k % 3 + 1] AS level,
  CASE WHEN value > 20 THEN 40 + k END AS sp, CASE WHEN k % 7 > 0 THEN 20 + k // 2 END AS sw, 2 + k % 2 AS sets FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""


def own_results(spark, sf) -> DataFrame:
    """Each event as a result of its user, with surface, level, serve points and sets."""
    s = samples(spark, sf).join(table(spark, sf, "events").select("event_id", F.col("event_type").alias("surface")), "event_id")
    k = F.col("k").cast("int")
    return s.select(
        F.col("user_id").alias("player"), F.col("ts").alias("at"), F.col("event_id").alias("result"), F.col("y").alias("won"), "surface", F.get(F.array(*map(F.lit, ("atp", "challenger", "itf"))), k % 3).alias("level"),
        F.when(F.col("value") > 20, 40 + k).cast("double").alias("serve_points"), F.when(k % 7 > 0, 20 + F.floor(k / 2)).cast("double").alias("serve_won"), (2 + k % 2).alias("sets"),
    )


def _profile_sql() -> str:
    tally = "count(*) AS matches, coalesce(sum(w), 0)::BIGINT AS wins"
    none = "NULL::DOUBLE AS points, NULL::DOUBLE AS points_won"
    cut_ = lambda kind, name, where, sets="NULL::BIGINT": f"SELECT player, '{kind}' AS kind, '{name}' AS name, count(*) FILTER ({where}) AS matches, coalesce(sum(w) FILTER ({where}), 0)::BIGINT AS wins, {none}, {sets} AS sets FROM r GROUP BY 1"
    age = lambda d: f"t >= latest - INTERVAL {d} DAY"
    parts = [f"SELECT player, '{c}' AS kind, {c} AS name, {tally}, {none}, NULL::BIGINT AS sets FROM r GROUP BY 1, 3" for c in ("surface", "level")]
    parts += [cut_("overall", "", "true"), cut_("last", "10", "n <= 10"), cut_("last", "20", "n <= 20"), cut_("days", "90", age(90)), cut_("days", "365", f"n <= 20 OR {age(365)}")]
    parts += [cut_("load", str(d), age(d), f"sum(sets) FILTER ({age(d)})::BIGINT") for d in (7, 30)]
    ok = "sp > 0 AND sw IS NOT NULL"
    parts.append(f"SELECT player, 'serve', '', count(*) FILTER (NOT coalesce({ok}, false)), 0::BIGINT, coalesce(sum(sp) FILTER ({ok}), 0)::DOUBLE, coalesce(sum(sw) FILTER ({ok}), 0)::DOUBLE, NULL::BIGINT FROM r GROUP BY 1")
    return f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY t DESC, result DESC) AS n, max(t) OVER (PARTITION BY player) AS latest FROM ({_RESULTS})), p AS ({" UNION ALL ".join(parts)})
SELECT *, CASE WHEN matches > 0 AND kind <> 'serve' THEN round(wins / matches::DOUBLE, 6) END AS win_rate FROM p"""


@query(_profile_sql())
def ag28_player_profiles(spark, sf):
    """Each player's counts in all, by surface and level, of the last results and days, load and serve."""
    return profiles.profile_rows(own_results(spark, sf))


@query()
def ag28_rating_folds(spark, sf):
    """Each player's ratings after the last result, in all and by surface, rounded after every result."""
    return profiles.rating_folds(own_results(spark, sf))


@query(f"""
WITH m AS ({_MATCHES}), v AS (SELECT *, least(w, l) AS a, greatest(w, l) AS b FROM m WHERE w <> l),
s AS (SELECT event_id, w AS player, 1 AS won, surface, ts, a, b FROM v UNION ALL SELECT event_id, l, 0, surface, ts, a, b FROM v)
SELECT event_id, player, count(*) OVER o AS played, coalesce(sum(won) OVER o, 0)::BIGINT AS wins, count(*) OVER f AS on_surface, coalesce(sum(won) OVER f, 0)::BIGINT AS wins_on_surface, count(*) OVER h AS met, coalesce(sum(won) OVER h, 0)::BIGINT AS won_of_met FROM s
WINDOW o AS (PARTITION BY player ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY player, surface ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  h AS (PARTITION BY a, b, player ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def u1_records_before(spark, sf):
    """What stood before each match for each side: matches and wins in all, on the surface and against the same opponent."""
    v = results(spark, sf).where("winner <> loser")
    pair = [F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b")]
    side = lambda c, won: v.select("event_id", F.col(c).alias("player"), F.lit(won).alias("won"), "surface", "ts", *pair)
    s = side("winner", 1).union(side("loser", 0))

    def before(*keys: str):
        w = Window.partitionBy(*keys).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
        return F.count("*").over(w), F.coalesce(F.sum("won").over(w), F.lit(0))

    (n, w), (ns, ws), (nh, wh) = before("player"), before("player", "surface"), before("a", "b", "player")
    return s.select("event_id", "player", n.alias("played"), w.alias("wins"), ns.alias("on_surface"), ws.alias("wins_on_surface"), nh.alias("met"), wh.alias("won_of_met"))


def match_rows(spark, sf) -> DataFrame:
    """Matches with surface, level and serve points of both sides; a tenth is told again three days later, some of these void or with the other winner."""
    e = results(spark, sf).join(samples(spark, sf).select("event_id", "k", "value", "hour"), "event_id")
    k = F.col("k").cast("int")
    level = F.element_at(F.array(*(F.lit(x) for x, _ in waves.HISTORY.priors)), F.pmod(k, F.lit(len(waves.HISTORY.priors))) + 1)
    points = {"winner_points": F.when(F.col("value") > 20, 40 + k), "winner_won": F.floor((40 + k) * 0.66), "loser_points": 45 + F.col("hour"), "loser_won": F.floor((45 + F.col("hour")) * 0.58)}
    first = e.select(
        F.col("event_id").alias("match_id"), F.col("ts").alias("available_at"), F.col("ts").alias("played_at"), "winner", "loser", "surface", level.alias("level"),
        F.lit(True).alias("valid"), *(v.cast("double").alias(c) for c, v in points.items()),
    )
    again = first.where("match_id % 10 = 3").withColumn("available_at", F.expr("available_at + interval 3 days"))
    again = again.withColumns({"winner": F.when(F.col("match_id") % 20 == 3, F.col("loser")).otherwise(F.col("winner")), "loser": F.when(F.col("match_id") % 20 == 3, F.col("winner")).otherwise(F.col("loser"))})
    return first.union(again.withColumn("valid", F.col("match_id") % 30 != 13).select(first.columns))


@query()
def u1_ratings_before(spark, sf):
    """Both sides before each match: Elo, Elo on the surface, Glicko-2, matches and wins, serve and return rates."""
    before, _ = waves.fold_matches(waves.current_matches(match_rows(spark, sf)))
    return before.select(
        "match_id", "player", "won", "elo", "surface_elo", (1500 + F.col("mu") * glicko.SCALE).alias("glicko"), (F.col("phi") * glicko.SCALE).alias("deviation"), F.col("sigma").alias("volatility"),
        "played", "wins", waves.serve_rate_column("serve_points", "serve_residual").alias("serve_rate"), waves.return_rate_column("return_points", "return_residual").alias("return_rate"),
    )


@query()
def u1_profiles_as_of(spark, sf):
    """Each player's state after the matches that were known and played by a cutoff, later corrections left out; a row for each surface too."""
    _, after = waves.fold_matches(waves.current_matches(match_rows(spark, sf), "2024-01-20 00:00:00"))
    whole = F.col("surface") == ""
    return after.select(
        "player", "surface", "elo", F.when(whole, 1500 + F.col("mu") * glicko.SCALE).alias("glicko"), F.when(whole, F.col("phi") * glicko.SCALE).alias("deviation"), F.when(whole, F.col("sigma")).alias("volatility"),
        F.when(whole, F.col("played")).alias("played"), F.when(whole, F.col("wins")).alias("wins"), F.timestamp_micros("last").cast("timestamp_ntz").alias("last"),
    )


@query()
def u3_rating_forecasts(spark, sf):
    """The rating candidate's chance of the first side, from snapshots before each match: falling steps, first ratings by level."""
    before, _ = waves.fold_matches(waves.current_matches(match_rows(spark, sf)), waves.HISTORY)
    serve = F.when(F.col("serve_points") >= 20, F.col("serve_won") / F.col("serve_points")).otherwise(waves.SERVE)
    side = lambda won, a: before.where(F.col("won") == won).select("match_id", F.struct("player", "elo", "surface_elo", (1500 + F.col("mu") * glicko.SCALE).alias("glicko"), (F.col("phi") * glicko.SCALE).alias("rd"), serve.alias("serve")).alias(a))
    m = side(True, "a").join(side(False, "b"), "match_id")
    gap = lambda c: F.col(f"a.{c}") - F.col(f"b.{c}")
    mixed = 0.5 * gap("elo") + 0.3 * gap("surface_elo") + 0.2 * gap("glicko")
    return m.select(
        "match_id", gap("elo").alias("elo_diff"), gap("surface_elo").alias("surface_elo_diff"), gap("glicko").alias("glicko_diff"), (0.5 * (F.col("a.rd") + F.col("b.rd"))).alias("glicko_rd"),
        gap("serve").alias("serve_rate_diff"), (1 / (1 + F.pow(F.lit(10.0), -mixed / 400))).alias("p"),
    )


@query()
def u4_platt(spark, sf):
    """Chances scaled by a logistic line fitted on the rows of the first three weeks."""
    s = samples(spark, sf)
    line = M.platt(s.where("ts < timestamp_ntz '2024-01-22'"))
    return s.where("ts >= timestamp_ntz '2024-01-22'").select("event_id", M.platt_scaled(F.col("p"), line).alias("p"))


@query()
def u4_isotonic(spark, sf):
    """Chances replaced by a rising step function fitted on the rows of the first three weeks."""
    s = samples(spark, sf)
    scale = M.isotonic(s.where("ts < timestamp_ntz '2024-01-22'"))
    return scale(s.where("ts >= timestamp_ntz '2024-01-22'")).select("event_id", "p")


@query()
def u5_estimators(spark, sf):
    """Log loss and Brier score of four estimators, fitted on one part of time and scored on the next.

    The rows are read once and dealt evenly by event: each estimator passes over them many times, in
    as many tasks as its input has parts, and a table of few large files or row groups has few.
    """
    s = cut(samples(spark, sf).select("event_id", "ts", *FEATURES, "y").repartition("event_id"), "samples")
    train, test = s.where("ts < timestamp_ntz '2024-01-22'"), s.where("ts >= timestamp_ntz '2024-01-22'")
    out = None
    for kind in ("lr", "gb", "rf", "mlp"):
        got = metrics.scores(M.fitted(train, FEATURES, kind)(test)).select(F.lit(kind).alias("model"), "n", "log_loss", "brier")
        out = got if out is None else out.union(got)
    return out


@query()
def u6_release(spark, sf):
    """A model fitted on early rows, calibrated on later ones and validated on the last, with the verdict of its gates."""
    s = samples(spark, sf)
    score = M.fitted_then_calibrated(s.where("ts < timestamp_ntz '2024-01-22'"), FEATURES, "ts")
    got = metrics.scores(score(s.where("ts >= timestamp_ntz '2024-01-22'")))
    return got.withColumn("released", F.expr("n >= 100 and brier <= 0.25 and log_loss <= 0.6931"))


def _forecasts(spark, sf) -> DataFrame:
    folds = walk_forward(samples(spark, sf).drop("p"), "ts", "event_id")
    return M.walk_forward_scores(folds, FEATURES, "ts", 4)


@query()
def u22_walk_forward_forecasts(spark, sf):
    """Forecasts of four folds, each by the model of its own past, calibrated on the last fifth of it."""
    return _forecasts(spark, sf).select("event_id", F.col("fold").cast("int").alias("fold"), "p", "y")


@query()
def u7_walk_forward_test(spark, sf):
    """The forecasts of each fold gated by edge, sized by a Kelly share and settled at the quoted price."""
    s = _forecasts(spark, sf).withColumn("stake", F.when(P.expected_value(F.col("p"), F.col("odds")) >= 0.02, F.round(1000 * F.least(P.kelly(F.col("p"), F.col("odds"), 0.25), F.lit(0.05)), 2)).otherwise(0.0))
    s = s.withColumn("pnl", F.when(F.col("y") == 1, F.col("stake") * (F.col("odds") - 1)).otherwise(-F.col("stake")))
    return s.groupBy(F.col("fold").cast("int").alias("fold")).agg(
        F.count("*").alias("n"), F.count_if(F.col("stake") > 0).alias("bets"), F.sum("stake").alias("turnover"), F.sum("pnl").alias("pnl"), (F.sum("pnl") / F.sum("stake")).alias("roi")
    )


def priced_matches(spark, sf) -> DataFrame:
    """Quotes of whole matches in two families: three events are a match, each quote weighs a part of it, and 60, 20 and 20 in a hundred matches by time train, stop and calibrate."""
    s = samples(spark, sf).withColumn("match_id", F.floor(F.col("event_id") / 3)).withColumn("market", F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("p"))))
    m = s.groupBy("match_id").agg(F.max("ts").alias("known"), (F.sum("y") >= 2).cast("int").alias("y"), F.count("*").alias("n"), F.when(F.max("k") > 60, "match").otherwise("set").alias("family"))
    m = cut(m, "priced_matches")
    places = None
    for family in ("match", "set"):
        own = ranked(m.where(F.col("family") == family), ["known", "match_id"])
        places = own if places is None else places.union(own)
    places = places.join(F.broadcast(m.groupBy("family").agg(F.count("*").alias("all"))), "family")  # two rows
    part = F.when(F.col("k") <= F.floor(0.6 * F.col("all")), "train").when(F.col("k") <= F.floor(0.8 * F.col("all")), "early").otherwise("calibration")
    places = places.select("match_id", "family", "y", (1 / F.col("n")).alias("weight"), part.alias("part"))
    return s.drop("y").join(places, "match_id").withColumn("margin", P.clipped_logit(F.col("market")))


HEAD = boosting.Settings(rounds=8, rate=0.1, patience=3)


@query()
def u23_market_offset(spark, sf):
    """Each family's head of trees on the market's logit, stopped on later matches and weighed on the last: chances of all quotes."""
    rows = cut(priced_matches(spark, sf), "quotes")
    out = None
    for family in ("match", "set"):
        own = rows.where(F.col("family") == family)
        head, _ = boosting.fit_head(own, FEATURES, HEAD)
        part = own.select("event_id", "family", "part", "market", head.chance().alias("p"), "y", "weight")
        out = part if out is None else out.union(part)
    return out


@query(f"""
SELECT event_id, greatest(1e-4::DOUBLE, least(0.9999::DOUBLE, 1 / (1 + exp(-(ln(m / (1 - m)) + greatest(-0.35::DOUBLE, least(0.35::DOUBLE, (value - 250) / 300))))))) AS p
FROM (SELECT *, greatest(1e-4::DOUBLE, least(0.9999::DOUBLE, CAST(json_extract(props, '$.k') AS INTEGER) / 100.0::DOUBLE)) AS m FROM events)
""")
def u21_offset_step(spark, sf):
    """A stored prediction moves the market's logit, at most by the reach."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select("event_id", boosting.offset(k / F.lit(100.0), (F.col("value") - 250) / 300).alias("p"))


@query()
def u21_residual_forecasts(spark, sf):
    """Quotes after three weeks forecast by trees on the residual of the market and by a regression held near it."""
    s = samples(spark, sf).withColumnRenamed("p", "market")
    train, new = s.where("ts < timestamp_ntz '2024-01-22'"), s.where("ts >= timestamp_ntz '2024-01-22'")
    a = M.residual_forecasts(train, new, ["value", "hour"], "market").select("event_id", "market", F.col("p").alias("p_trees"), F.col("shift").alias("shift_trees"))
    b = M.residual_forecasts(train, new, ["value", "hour"], "market", "lr").select("event_id", F.col("p").alias("p_line"), F.col("shift").alias("shift_line"))
    return a.join(b, "event_id")


_VOTE = """CASE WHEN greatest(CASE WHEN a > 1 THEN p{0} * a - 1 ELSE -1 END, CASE WHEN b > 1 THEN round(1 - p{0}, 4) * b - 1 ELSE -1 END) < 0.02 THEN 'NO_EDGE'
  WHEN o{0} < 1.2 THEN 'ODDS_TOO_SHORT' WHEN o{0} >= 6 THEN 'ODDS_TOO_LONG' WHEN c{0} < 0.55 THEN 'PROBABILITY_TOO_LOW' ELSE '' END AS r{0}"""
_FIRST = "(CASE WHEN a > 1 THEN round(p{0} * a - 1, 4) ELSE -1 END) >= (CASE WHEN b > 1 THEN round(round(1 - p{0}, 4) * b - 1, 4) ELSE -1 END) AS f{0}"
_LINES = (1, 2, 3)


def _each(text: str) -> str:
    return ", ".join(text.format(i) for i in _LINES)


@query(f"""
WITH e AS (SELECT event_id, 1 + value / 100 AS a, 6 - value / 100 AS b, CAST(json_extract(props, '$.k') AS INTEGER) / 100.0::DOUBLE AS p1, least(0.99, value / 500 + 0.2) AS p2, (event_id % 80 + 20) / 100.0::DOUBLE AS p3 FROM events),
f AS (SELECT *, {_each(_FIRST)} FROM e), c AS (SELECT *, {_each("CASE WHEN f{0} THEN p{0} ELSE round(1 - p{0}, 4) END AS c{0}, CASE WHEN f{0} THEN a ELSE b END AS o{0}")} FROM f), r AS (SELECT *, {_each(_VOTE)} FROM c),
s AS (SELECT *, {_each("CASE WHEN r{0} = '' THEN CASE WHEN f{0} THEN 'a' ELSE 'b' END END AS s{0}")} FROM r),
n AS (SELECT *, len(list_filter([s1, s2, s3], lambda x: x = 'a')) AS na, len(list_filter([s1, s2, s3], lambda x: x = 'b')) AS nb, (round(c1, 4) + round(c2, 4) + round(c3, 4)) / 3 AS m FROM s)
SELECT event_id, CASE WHEN na = 3 THEN 'a' WHEN nb = 3 THEN 'b' END AS side, CASE WHEN na = 3 THEN round(m, 4) WHEN nb = 3 THEN round(1 - m, 4) ELSE round((round(p1, 4) + round(p2, 4) + round(p3, 4)) / 3, 4) END AS p_a,
  CAST(greatest(na, nb) AS INTEGER) AS agreed, r1 || ',' || r2 || ',' || r3 AS reasons FROM n
""")
def u24_votes(spark, sf):
    """Three lines' stored chances voted on at two prices: a side only where all three confirm it."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").select(
        "event_id", (1 + F.col("value") / 100).alias("a"), (6 - F.col("value") / 100).alias("b"), (k / F.lit(100.0)).alias("p1"), F.least(F.lit(0.99), F.col("value") / 500 + 0.2).alias("p2"),
        ((F.col("event_id") % 80 + 20) / F.lit(100.0)).alias("p3"),
    )
    return M.composite(e, ["p1", "p2", "p3"], "a", "b").select("event_id", "side", "p_a", "agreed", "reasons")


def pinned_models(train: DataFrame, place: str) -> dict[str, str]:
    """The three lines fitted, published and pinned: name to digest."""
    spark = train.sparkSession
    payloads = {"logistic": ("linear", M.linear_payload(train, FEATURES))}
    head, _ = boosting.fit_head(train, FEATURES, HEAD._replace(rounds=4))
    payloads["boosting"] = ("boosted", json.dumps({"model": json.loads(head.model.dumped()), "share": head.share}, sort_keys=True))
    payloads["residual_network"] = ("network", M.network_payload(train, FEATURES))
    return {name: registry.publish(spark, place, name, "1.0.0", *payload) for name, payload in payloads.items()}


@query()
def u24_composite(spark, sf):
    """Three models published, pinned, read back and scored in one pass; a side only where all three confirm it."""
    rows = cut(priced_matches(spark, sf).where("family = 'match'").withColumns({"a": F.round(0.95 / F.col("market"), 2), "b": F.round(0.95 / (1 - F.col("market")), 2)}), "quotes")
    place = new_path(spark, "registry")
    pins = pinned_models(rows.where("part <> 'calibration'"), place)
    models = {name: registry.read(spark, place, name, "1.0.0", pin) for name, pin in pins.items()}
    lines = [f"p_{n}" for n in sorted(models)]
    return M.composite(registry.scored(rows.where("part = 'calibration'"), models, FEATURES), lines, "a", "b").select("event_id", *lines, "side", "p_a", "agreed", "reasons")
