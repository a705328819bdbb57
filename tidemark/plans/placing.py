"""Bets checked before they are placed, and the gates of a model's promotion, from what the tables hold.

A purchase is a proposal of its user at its time. Its event is the order of its number, the market
that order's first line and the selection its last one; the user's clicks are quotes, views predictions
and signups decisions; the customer of the user's number is the account.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import asof_backward
from ..operators.placing import Limits, checked
from ..sources.tables import table
from .registry import query

#: Ages and shares at the pace of these tables, whose events are hours apart.
LIMITS = Limits(quote_age=86400.0, state_age=1800.0, prediction_age=2 * 86400.0, decision_age=3 * 86400.0, least_chance=0.2, least_edge=-0.4, odds=(1.05, 5.5), least_stake=5.0, most_exposure=0.5, slippage=0.6)
DAY = 86400


def proposals(spark, sf) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").withColumn("k", k)
    bets = e.where("event_type = 'purchase'").select(
        F.col("event_id").alias("bet_id"), "event_id", "user_id", F.col("ts").alias("now"), F.lit("match_winner").alias("market"), F.when(F.col("k") % 10 == 7, "draw").when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("outcome"),
        F.when(F.col("k") == 97, "chess").when(F.col("k") % 10 == 7, "football").otherwise("tennis").alias("sport"), (1 + F.col("value") / 100).alias("odds"), (F.col("k") / 100).alias("p"),
        (F.col("k") / 100 * (1 + F.col("value") / 100) - 1).alias("edge"), F.col("value").alias("stake"), (F.col("event_id") % 5).alias("slot"), (F.col("event_id") % 3 != 0).alias("lost"),
    )
    # What the account holds open: stakes of the day before, and the losses of this day so far, by range windows of a slice's size.
    u = F.unix_micros(F.col("now").cast("timestamp"))
    bets = bets.withColumn("u", u)
    day = lambda *keys: Window.partitionBy(*keys).orderBy("u").rangeBetween(-DAY * 1_000_000, -1)
    bets = _with_day_before(bets).withColumns({
        "exposure": F.coalesce(F.sum("stake").over(day("user_id", "slice")), F.lit(0.0)), "doubled": F.count("*").over(day("user_id", "slice", "slot", "outcome")) > 0,
        "lost_today": F.coalesce(F.sum(F.when(F.col("lost"), F.col("stake"))).over(Window.partitionBy("user_id", "slice", F.to_date("now")).orderBy("u").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
    }).where("own").drop("slice", "own", "u")
    quote = lambda kind, *columns: e.where(f"event_type = '{kind}'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("rid"), *columns)
    bets = asof_backward(bets, quote("click", (1 + F.col("value") / 100).alias("current_odds")), "user_id", "now", "at", ["current_odds"], tie="rid").withColumnRenamed("matched_at", "quoted_at")
    bets = asof_backward(bets, quote("view", (F.col("k") % 10 == 0).alias("shadow"), (F.col("value") > 20).alias("model_active")), "user_id", "now", "at", ["shadow", "model_active"], tie="rid").withColumnRenamed("matched_at", "predicted_at")
    bets = asof_backward(bets, quote("signup", F.when(F.col("k") < 10, "no_bet").otherwise("bet").alias("verdict")), "user_id", "now", "at", ["verdict"], tie="rid").withColumnRenamed("matched_at", "decided_at")
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "finished").otherwise("live").alias("event_status"), (F.col("o_orderstatus") != "P").alias("live"), (F.col("o_totalprice").cast("long") % 2400).alias("old"))
    spot = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_returnflag", spot).alias("first"), F.max_by("l_returnflag", spot).alias("last"))
    status = lambda c: F.when(F.col(c).isNotNull(), F.when(F.col(c) == "R", "Suspended").otherwise("open"))
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 2).alias("balance"), (F.col("c_acctbal") / 2 + 200).alias("first_balance"))
    rows = bets.join(o, F.col("event_id") == F.col("o_orderkey"), "left").join(lines, F.col("event_id") == F.col("l_orderkey"), "left").join(c, F.col("user_id") == F.col("c_custkey"), "left")
    return rows.withColumns({"seen_at": F.expr("now - make_dt_interval(0, 0, 0, old)"), "market_status": status("first"), "selection_status": status("last")})


def _with_day_before(bets: DataFrame) -> DataFrame:
    """Each row in its day's slice and, not its own, in the next, so that windows of a day need no more than a slice of a user."""
    at = F.floor(F.col("u") / (DAY * 1_000_000))
    return bets.withColumn("slice", F.explode(F.array(at, at + 1))).withColumn("own", F.col("slice") == at)


_CHECKS = [
    ("SPORT_SUPPORT", "sport = 'chess'"), ("SPORT_RULES", "odds <= 1 OR p <= 0 OR (outcome = 'draw' AND sport <> 'football')"), ("MODEL_STATUS", "predicted_at IS NOT NULL AND (shadow OR NOT active)"), ("PREDICTION_FRESHNESS", "now - predicted_at > INTERVAL 2 DAY"),
    ("LLM_FRESHNESS", "now - decided_at > INTERVAL 3 DAY"), ("LLM_VERDICT", "verdict = 'no_bet'"), ("EVENT_EXISTS", "status IS NULL"), ("EVENT_ACTIVE", "status = 'finished'"), ("EVENT_IN_PLAY", "status IS NOT NULL AND (NOT live OR status <> 'live')"),
    ("EVENT_FRESHNESS", "old IS NULL OR old > 1800"), ("MARKET_EXISTS", "market IS NULL"), ("MARKET_ACTIVE", "market = 'R'"), ("SELECTION_EXISTS", "selection IS NULL"), ("SELECTION_ACTIVE", "selection = 'R'"),
    ("ODDS_FRESHNESS", "quoted_at IS NULL OR now - quoted_at > INTERVAL 1 DAY"), ("CONFIDENCE_THRESHOLD", "p < 0.2"), ("EDGE_THRESHOLD", "edge < -0.4"), ("ODDS_BOUNDS", "current < 1.05 OR current > 5.5"),
    ("SLIPPAGE_EDGE", "p * current - 1 < -0.4 OR current < odds * (1 - 0.6)"), ("DUPLICATE_CHECK", "doubled > 0"), ("STAKE_LIMITS", "stake < 5 OR stake > round(balance * 0.2, 2)"), ("BANKROLL_SUFFICIENCY", "stake > balance"),
    ("EXPOSURE_LIMIT", "coalesce(exposure, 0) + stake > first_balance * 0.5"), ("DAILY_LOSS_LIMIT", "coalesce(lost_today, 0) >= first_balance * 0.15"),
]
_NAMES = ["SCHEMA_VALIDATION", *(n for n, _ in _CHECKS)]


def _sql() -> str:
    fails = ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _CHECKS)
    outcome = "CASE WHEN k % 10 = 7 THEN 'draw' WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END"
    day = "RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
    return f"""
WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
b AS (SELECT event_id, user_id, ts AS now, CASE WHEN k = 97 THEN 'chess' WHEN k % 10 = 7 THEN 'football' ELSE 'tennis' END AS sport, {outcome} AS outcome, 1 + value / 100 AS odds, k / 100.0::DOUBLE AS p, k / 100.0::DOUBLE * (1 + value / 100) - 1 AS edge, value AS stake,
  sum(value) OVER (PARTITION BY user_id ORDER BY ts {day}) AS exposure, count(*) OVER (PARTITION BY user_id, event_id % 5, {outcome} ORDER BY ts {day}) AS doubled,
  sum(CASE WHEN event_id % 3 <> 0 THEN value END) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS lost_today FROM e WHERE event_type = 'purchase'),
q AS (SELECT b.*, c.ts AS quoted_at, 1 + c.value / 100 AS current FROM b ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') c ON c.user_id = b.user_id AND b.now >= c.ts),
v AS (SELECT q.*, c.ts AS predicted_at, c.k % 10 = 0 AS shadow, c.value > 20 AS active FROM q ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') c ON c.user_id = q.user_id AND q.now >= c.ts),
d AS (SELECT v.*, c.ts AS decided_at, CASE WHEN c.k < 10 THEN 'no_bet' WHEN c.k >= 10 THEN 'bet' END AS verdict FROM v ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'signup') c ON c.user_id = v.user_id AND v.now >= c.ts),
l AS (SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS market, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS selection FROM lineitem GROUP BY 1),
x AS (SELECT d.*, CASE WHEN o_orderstatus IS NULL THEN NULL WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'live' END AS status, o_orderstatus <> 'P' AS live, floor(o_totalprice)::BIGINT % 2400 AS old, market, selection, c_acctbal / 2 AS balance, c_acctbal / 2 + 200 AS first_balance
  FROM d LEFT JOIN orders ON o_orderkey = event_id LEFT JOIN l ON l_orderkey = event_id LEFT JOIN customer ON c_custkey = user_id),
f AS (SELECT event_id, list_filter([{fails}], lambda y: y IS NOT NULL) AS failed FROM x)
SELECT event_id AS bet_id, coalesce(failed[1], '') AS reason, CAST(CASE WHEN len(failed) = 0 THEN {len(_NAMES)} ELSE list_position({_NAMES!r}, failed[1]) - 1 END AS INTEGER) AS passed, array_to_string(failed, ',') AS failed FROM f"""


@query(_sql())
def fil11_all_checks(spark, sf):
    """All checks of each bet in order: the first that fails is the reason, and the others are told as well."""
    return checked(proposals(spark, sf), LIMITS)


@query("""
WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) / 100.0::DOUBLE AS p, 1 + value / 100 AS odds, (CAST(json_extract(props, '$.k') AS INTEGER) / 100.0::DOUBLE + value / 1000 + (event_id * 7919 % 101) / 101.0) > 1.1 AS won, ts >= TIMESTAMP '2024-01-16' AS current FROM events),
t AS (SELECT user_id, count(*) FILTER (NOT current) AS a, count(*) FILTER (current) AS b FROM e GROUP BY 1),
n AS (SELECT user_id, least(floor(p * 10), 9) AS bin, count(*) FILTER (NOT current) AS a, count(*) FILTER (current) AS b FROM e GROUP BY 1, 2),
s AS (SELECT user_id, sum((greatest(n.b / t.b::DOUBLE, 1e-4) - greatest(n.a / t.a::DOUBLE, 1e-4)) * ln(greatest(n.b / t.b::DOUBLE, 1e-4) / greatest(n.a / t.a::DOUBLE, 1e-4))) AS psi FROM n JOIN t USING (user_id) WHERE t.a > 0 AND t.b > 0 GROUP BY 1),
m AS (SELECT user_id, date_diff('second', min(ts), max(ts)) / 86400.0 AS days, count(*) AS n, avg((p - won::INT) * (p - won::INT)) - avg((1 / odds - won::INT) * (1 / odds - won::INT)) AS brier_delta,
  sum(CASE WHEN p * odds - 1 >= 0.02 THEN CASE WHEN won THEN odds - 1 ELSE -1 END END) / count(*) FILTER (p * odds - 1 >= 0.02) AS roi FROM e GROUP BY 1)
SELECT user_id, n, round(psi, 6) AS psi, round(roi, 6) AS roi, round(brier_delta, 6) AS brier_delta, array_to_string(list_filter([CASE WHEN days < 7 THEN 'shadow_days' END, CASE WHEN n < 100 THEN 'paired_observations' END, CASE WHEN psi IS NULL OR psi > 0.25 THEN 'psi' END,
  CASE WHEN roi IS NULL OR roi < 0 THEN 'counterfactual_roi' END, CASE WHEN brier_delta > 0.02 THEN 'brier_delta' END], lambda x: x IS NOT NULL), ',') AS blocked FROM m LEFT JOIN s USING (user_id)
""")
def fil28_promotion(spark, sf):
    """The gates that keep each user's model from release: days in shadow, paired rows, the stability of its chances, its bets' return and its Brier score against the market's."""
    k = F.get_json_object("props", "$.k").cast("int")
    noise = (F.col("event_id") * 7919 % 101) / 101
    e = table(spark, sf, "events").select("user_id", "ts", (k / 100).alias("p"), (1 + F.col("value") / 100).alias("odds"), ((k / 100 + F.col("value") / 1000 + noise) > 1.1).cast("int").alias("y"), (F.col("ts") >= F.expr("timestamp_ntz '2024-01-16'")).alias("current"))
    bins = e.groupBy("user_id", F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count_if(~F.col("current")).alias("a"), F.count_if("current").alias("b"))
    total = bins.groupBy("user_id").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.collect_list(F.struct("a", "b")).alias("bins"))  # ten bins a user at the most
    share = lambda x, t: F.greatest(x / t, F.lit(1e-4))
    gap = lambda r: (share(r["b"], F.col("tb")) - share(r["a"], F.col("ta"))) * F.ln(share(r["b"], F.col("tb")) / share(r["a"], F.col("ta")))
    psi = total.where("ta > 0 and tb > 0").select("user_id", F.aggregate("bins", F.lit(0.0), lambda s, r: s + gap(r)).alias("psi"))
    square = lambda x: (x - F.col("y")) * (x - F.col("y"))
    bet = F.col("p") * F.col("odds") - 1 >= 0.02
    seconds = F.unix_seconds(F.max(F.col("ts").cast("timestamp"))) - F.unix_seconds(F.min(F.col("ts").cast("timestamp")))
    m = e.groupBy("user_id").agg(
        (seconds / 86400).alias("days"), F.count("*").alias("n"), (F.avg(square(F.col("p"))) - F.avg(square(1 / F.col("odds")))).alias("brier_delta"),
        F.try_divide(F.sum(F.when(bet, F.when(F.col("y") == 1, F.col("odds") - 1).otherwise(-1.0))), F.count_if(bet)).alias("roi"),
    )
    rules = {"shadow_days": "days < 7", "paired_observations": "n < 100", "psi": "psi is null or psi > 0.25", "counterfactual_roi": "roi is null or roi < 0", "brier_delta": "brier_delta > 0.02"}
    blocked = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()]))
    return m.join(psi, "user_id", "left").select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("psi", "roi", "brier_delta")], F.array_join(blocked, ",").alias("blocked"))
