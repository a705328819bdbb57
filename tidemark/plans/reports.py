"""Reports on forecasts and bets, quality checks of feeds, quotas and confirmed signals.

``events`` stands for forecasts (probability props.k percent, price 1 + value / 100, won above 250).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.asof import asof_backward
from ..operators.equity import bootstrap_mean, total_and_drawdown
from ..operators.series import confirmations
from ..sources.tables import table
from .registry import query

_F = """SELECT event_id, user_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) / 100.0::DOUBLE AS p, 1 + value / 100 AS odds, CAST(value > 250 AS INTEGER) AS y,
  CASE WHEN value > 250 THEN value / 100 ELSE -1 END::DOUBLE AS pnl FROM events"""


def _forecasts(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.get_json_object("props", "$.k").cast("int") / F.lit(100.0))
    y = F.col("value") > 250
    return e.select("event_id", "user_id", "ts", "event_type", "value", "p", (1 + F.col("value") / 100).alias("odds"), y.cast("int").alias("y"), F.when(y, F.col("value") / 100).otherwise(-1.0).alias("pnl"))


@query(f"SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 8) AS mean_p, round(avg(y), 8) AS rate FROM ({_F}) GROUP BY 1")
def ag4_reliability(spark, sf):
    """Ten bins of forecasts with what happened; bins without rows are left out."""
    bins = M.calibration_bins(_forecasts(spark, sf), 10)
    names = bins.columns
    return bins.where(F.col(names[1]) > 0).select(F.col(names[0]).alias("bin"), F.col(names[1]).alias("n"), F.round(names[2], 8).alias("mean_p"), F.round(names[3], 8).alias("rate"))


@query(f"""
SELECT event_type, count(*) AS n, count(DISTINCT y) < 2 AS insufficient, CASE WHEN count(DISTINCT y) = 2 THEN round(avg((p - y) * (p - y)), 8) END AS brier FROM ({_F} WHERE event_type <> 'error' OR value > 250) GROUP BY 1
""")
def ag6_family_metrics(spark, sf):
    """Metrics of each family; one class only is not sufficient."""
    rows = _forecasts(spark, sf).where("event_type <> 'error' or value > 250")
    one = F.min("y") == F.max("y")
    brier = F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 8)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), one.alias("insufficient"), F.when(~one, brier).alias("brier"))


@query()
def ag10_bootstrap_interval(spark, sf):
    """The mean profit with its resampled interval."""
    return bootstrap_mean(_forecasts(spark, sf), "event_id", "pnl")


@query()
def ag12_paired_bootstrap(spark, sf):
    """Difference of two models' loss per match, with its resampled interval."""
    f = _forecasts(spark, sf)
    per_match = f.groupBy("user_id").agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")) - (1 / F.col("odds") - F.col("y")) * (1 / F.col("odds") - F.col("y"))).alias("gap"))
    return bootstrap_mean(per_match, "user_id", "gap")


@query(f"""
WITH e AS (SELECT event_type, ts, event_id, sum(pnl) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS equity FROM ({_F})),
d AS (SELECT event_type, greatest(0, max(equity) OVER (PARTITION BY event_type ORDER BY ts, event_id)) - equity AS fall FROM e)
SELECT event_type, round(total, 4) AS total, round(total / n, 6) AS roi, round(drawdown, 4) AS drawdown FROM (SELECT event_type, sum(pnl) AS total, count(*) AS n FROM ({_F}) GROUP BY 1) JOIN (SELECT event_type, max(fall) AS drawdown FROM d GROUP BY 1) USING (event_type)
""")
def ag13_bet_summary(spark, sf):
    """Unit-stake profit and drawdown of each model; long histories are dealt by day."""
    rows = _forecasts(spark, sf).withColumn("day", F.to_date("ts"))
    n = rows.groupBy("event_type").agg(F.count("*").alias("n"))
    fell = total_and_drawdown(rows, "event_type", "day", ["ts", "event_id"], "pnl")
    return fell.join(n, "event_type").select("event_type", F.round("total", 4).alias("total"), F.round(F.col("total") / F.col("n"), 6).alias("roi"), F.round("max_drawdown", 4).alias("drawdown"))


@query(f"""
SELECT event_type, count(*) >= 100 AND avg((p - y) * (p - y)) - avg((1 / odds - y) * (1 / odds - y)) <= 0.02 AND avg(ln(odds)) > 0 AS beats FROM ({_F}) GROUP BY 1
""")
def ag14_beats_market(spark, sf):
    """Enough rows, no worse Brier score than the market's, and good prices."""
    sq = lambda c: F.avg((c - F.col("y")) * (c - F.col("y")))
    beats = (F.count("*") >= 100) & (sq(F.col("p")) - sq(1 / F.col("odds")) <= 0.02) & (F.avg(F.ln("odds")) > 0)
    return _forecasts(spark, sf).groupBy("event_type").agg(beats.alias("beats"))


@query("""
SELECT o_orderpriority AS model, year(o_orderdate) AS version, count(*) FILTER (o_orderstatus = 'F') AS won, count(*) FILTER (o_orderstatus = 'O') AS lost, count(*) FILTER (o_orderstatus = 'P') AS pending,
  CASE WHEN count(*) FILTER (o_orderstatus <> 'P') > 0 THEN count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus <> 'P')::DOUBLE END AS rate FROM orders GROUP BY ALL
""")
def ag18_live_record(spark, sf):
    """Settled and open bets of each model and version."""
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    settled = F.count_if(F.col("o_orderstatus") != "P")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("version")).agg(
        is_("F").alias("won"), is_("O").alias("lost"), is_("P").alias("pending"), F.when(settled > 0, is_("F") / settled).alias("rate"))


@query(f"""
SELECT count(*) AS bets, sum(y) AS won, round(sum(pnl), 4) AS profit, round(100 * sum(pnl) / count(*), 6) AS roi_percent, count(DISTINCT user_id) AS players FROM ({_F} WHERE event_type <> 'signup')
""")
def ag20_portfolio(spark, sf):
    """Figures of the whole portfolio; the return is in percent."""
    rows = _forecasts(spark, sf).where("event_type <> 'signup'")
    return rows.agg(F.count("*").alias("bets"), F.sum("y").alias("won"), F.round(F.sum("pnl"), 4).alias("profit"), F.round(100 * F.sum("pnl") / F.count("*"), 6).alias("roi_percent"), F.count_distinct("user_id").alias("players"))


@query(f"""
SELECT event_type, count(*) FILTER (p >= 0.3) AS taken, count(*) FILTER (p < 0.3 AND odds > 3) AS vetoed_good_price, count(*) FILTER (p < 0.3 AND y = 1) AS missed_winners, round(sum(pnl) / count(*), 6) AS roi_all,
  round(sum(CASE WHEN p >= 0.3 THEN pnl ELSE 0 END) / greatest(1, count(*) FILTER (p >= 0.3)), 6) AS roi_taken FROM ({_F}) GROUP BY 1
""")
def ag34_veto_comparison(spark, sf):
    """The same candidates with and without a second opinion's veto."""
    taken = F.col("p") >= 0.3
    n = F.count_if(taken)
    return _forecasts(spark, sf).groupBy("event_type").agg(
        n.alias("taken"), F.count_if(~taken & (F.col("odds") > 3)).alias("vetoed_good_price"), F.count_if(~taken & (F.col("y") == 1)).alias("missed_winners"),
        F.round(F.sum("pnl") / F.count("*"), 6).alias("roi_all"), F.round(F.sum(F.when(taken, F.col("pnl")).otherwise(0.0)) / F.greatest(F.lit(1), n), 6).alias("roi_taken"),
    )


@query("""
SELECT CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' WHEN ts < TIMESTAMP '2024-01-25' THEN 'validate' ELSE 'test' END AS split, count(DISTINCT user_id) AS matches, bool_or(value > 250) AND bool_or(value <= 250) AS both_classes FROM events GROUP BY 1
""")
def ag38_window_summary(spark, sf):
    """Labelled matches in each split, and whether both classes are there."""
    split = F.when(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"), "train").when(F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz"), "validate").otherwise("test")
    high = F.col("value") > 250
    return table(spark, sf, "events").groupBy(split.alias("split")).agg(F.count_distinct("user_id").alias("matches"), (F.bool_or(high) & F.bool_or(~high)).alias("both_classes"))


@query("""
WITH s AS (SELECT user_id, unnest([CASE WHEN event_type IN ('view', 'click') THEN 'state' END, CASE WHEN value > 100 THEN 'odds' END, CASE WHEN event_type = 'purchase' THEN 'result' END]) AS g FROM events)
SELECT g AS source, count(*) AS rows, count(DISTINCT user_id) AS matches FROM s WHERE g IS NOT NULL GROUP BY 1
""")
def ag39_source_coverage(spark, sf):
    """Rows and matches that each group of sources covers."""
    groups = F.array(F.when(F.col("event_type").isin("view", "click"), "state"), F.when(F.col("value") > 100, "odds"), F.when(F.col("event_type") == "purchase", "result"))
    rows = table(spark, sf, "events").select("user_id", F.explode(groups).alias("source")).where("source is not null")
    return rows.groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("matches"))


@query("SELECT count(*) AS docs, count(DISTINCT text) AS texts, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, sum(length(text)) AS chars FROM documents")
def ag41_corpus_counts(spark, sf):
    """Counts over the whole corpus; texts are told apart by their hash."""
    d = table(spark, sf, "documents").withColumn("h", F.sha2("text", 256))
    return d.agg(F.count("*").alias("docs"), F.count_distinct("h").alias("texts"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.sum(F.length("text")).alias("chars"))


@query("SELECT o_orderkey, 1.0::DOUBLE / count(*) OVER (PARTITION BY o_custkey) AS weight FROM orders")
def ag35_balanced_weights(spark, sf):
    """Rows of one match weigh 1 together; the counts are joined, so that a long match is not one task's."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return o.join(n, "o_custkey").select("o_orderkey", (1.0 / F.col("n")).alias("weight"))


@query("SELECT event_id, (1 / odds) / (1 / odds + 1 / o2) AS a, (1 / o2) / (1 / odds + 1 / o2) AS b FROM (SELECT event_id, 1 + value / 100 AS odds, 1 + (event_id % 50 + 1) / 20.0::DOUBLE AS o2 FROM events)")
def ag36_two_way_shares(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (1 / (1 + F.col("value") / 100)).alias("x"), (1 / (1 + (F.col("event_id") % 50 + 1) / 20.0)).alias("y"))
    return rows.select("event_id", (F.col("x") / (F.col("x") + F.col("y"))).alias("a"), (F.col("y") / (F.col("x") + F.col("y"))).alias("b"))


@query("""
SELECT user_id, count(*) AS n, sum(CAST(coalesce(prev > ts, false) AS INTEGER)) AS backwards FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS prev FROM events) GROUP BY 1
""")
def w19_time_order(spark, sf):
    """Rows whose time is before the one of the row that came in before them."""
    w = Window.partitionBy("user_id").orderBy("event_type", "event_id")
    rows = table(spark, sf, "events").select("user_id", "ts", F.lag("ts").over(w).alias("prev"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("prev") > F.col("ts")).alias("backwards"))


@query(f"SELECT severity, count(*) AS n FROM (SELECT CASE WHEN odds <= 1.05 THEN 'CRITICAL' WHEN odds > 5 THEN 'WARNING' WHEN user_id % 9 - 1 < 0 THEN 'NEGATIVE' ELSE 'OK' END AS severity FROM ({_F})) GROUP BY 1")
def w22_w23_validity(spark, sf):
    """Prices at or under a floor, very high ones, and counts under zero."""
    s = F.when(F.col("odds") <= 1.05, "CRITICAL").when(F.col("odds") > 5, "WARNING").when(F.col("user_id") % 9 - 1 < 0, "NEGATIVE").otherwise("OK")
    return _forecasts(spark, sf).groupBy(s.alias("severity")).agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT user_id, ts, event_id, event_type, event_type <> lag(event_type) OVER w AS turned, value - lag(value) OVER w AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN turned AND step > 0 THEN 'a' WHEN turned AND step < 0 THEN 'b' END AS winner FROM f
""")
def w9_frame_change(spark, sf):
    """What changed between neighbouring frames."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = table(spark, sf, "events").select("event_id", (F.col("event_type") != F.lag("event_type").over(w)).alias("turned"), (F.col("value") - F.lag("value").over(w)).alias("step"))
    return f.select("event_id", F.when(F.col("turned") & (F.col("step") > 0), "a").when(F.col("turned") & (F.col("step") < 0), "b").alias("winner"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM c),
q AS (SELECT *, CASE WHEN total <= 12 THEN n ELSE 12 * n // total END AS whole, CASE WHEN total <= 12 THEN 0 ELSE 12 * n % total END AS rest FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rest * 1.0::DOUBLE / total DESC, event_type) AS place, sum(whole) OVER (PARTITION BY user_id) AS given FROM q)
SELECT user_id, event_type, CAST(whole + CASE WHEN total > 12 AND place <= 12 - given THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r
""")
def w13_quota(spark, sf):
    """Twelve rows a match, shared by the families' sizes; the largest remainders get the rest."""
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    by = Window.partitionBy("user_id")
    few = F.col("total") <= 12
    q = c.withColumn("total", F.sum("n").over(by)).withColumn("whole", F.when(few, F.col("n")).otherwise(F.expr("12 * n div total"))).withColumn("rest", F.when(few, 0).otherwise(F.expr("12 * n % total")))
    q = q.withColumn("place", F.row_number().over(by.orderBy(F.desc(F.col("rest") / F.col("total")), "event_type"))).withColumn("given", F.sum("whole").over(by))
    return q.select("user_id", "event_type", (F.col("whole") + F.when(~few & (F.col("place") <= 12 - F.col("given")), 1).otherwise(0)).alias("quota"))


@query(f"""
WITH f AS (SELECT * FROM ({_F}) WHERE event_type = 'purchase'), q AS (SELECT user_id, ts, event_id, odds FROM ({_F}) WHERE event_type = 'view'),
j AS (SELECT f.event_id, f.user_id, f.ts, f.p, q.odds AS price FROM f ASOF LEFT JOIN q ON f.user_id = q.user_id AND f.ts >= q.ts),
s AS (SELECT *, CASE WHEN price IS NULL THEN NULL WHEN p * price - 1 >= 0.03 THEN 'a' WHEN (1 - p) * 2 - 1 >= 0.03 THEN 'b' END AS side FROM j),
n AS (SELECT *, lag(side) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s)
SELECT user_id, arg_min(event_id, {{'t': ts, 'i': event_id}}) AS event_id, arg_min(side, {{'t': ts, 'i': event_id}}) AS side FROM n WHERE side = before GROUP BY 1
""")
def w35_confirmed_signal(spark, sf):
    """A forecast against the price of its time, gated, twice in a row: one signal a match."""
    f = _forecasts(spark, sf)
    quotes = f.where("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("qid"), F.col("odds").alias("price"))
    rows = asof_backward(f.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "p"), quotes, "user_id", "ts", "at", ["price"], tie="qid")
    side = F.when(F.col("price").isNull(), None).when(F.col("p") * F.col("price") - 1 >= 0.03, "a").when((1 - F.col("p")) * 2 - 1 >= 0.03, "b")
    return confirmations(rows.withColumn("side", side), "user_id", ["ts", "event_id"], "side", 2).select("user_id", "event_id", "side")


@query("SELECT user_id FROM (SELECT user_id, max(ts) AS last FROM events WHERE user_id % 3 <> 0 GROUP BY 1) ORDER BY last DESC, user_id LIMIT 20")
def w44_unseen_holdout(spark, sf):
    """The newest matches that are in no reserved set."""
    e = table(spark, sf, "events").select("user_id", "ts")
    reserved = e.select("user_id").where("user_id % 3 = 0").distinct()
    return e.join(reserved, "user_id", "left_anti").groupBy("user_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "user_id").limit(20).select("user_id")


@query("""
WITH s AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('view', 'click') THEN value END AS clock, event_type = 'error' AS paused FROM events)
SELECT event_id, last_value(clock IGNORE NULLS) OVER w AS base, last_value(CASE WHEN clock IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS since, paused FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def w48_carried_clock(spark, sf):
    """The last clock that was shown, with its time, carried to rows that show none."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    clock = F.when(F.col("event_type").isin("view", "click"), F.col("value"))
    return table(spark, sf, "events").select("event_id", F.last(clock, True).over(w).alias("base"), F.last(F.when(clock.isNotNull(), F.col("ts")), True).over(w).alias("since"), (F.col("event_type") == "error").alias("paused"))


@query(f"""
WITH g AS (SELECT event_type AS mode, user_id % 10 AS grid, sum(pnl) AS profit, count(*) AS bets, max(value) AS worst FROM ({_F}) GROUP BY ALL HAVING count(*) >= 20)
SELECT mode, arg_min(grid, {{'a': -round(profit / bets, 9), 'b': worst, 'c': -bets, 'd': grid}}) AS grid FROM g GROUP BY 1
""")
def t4_best_of_eligible(spark, sf):
    """Of the settings with enough bets: the best return, then the smaller risk, more bets, the smaller setting."""
    g = _forecasts(spark, sf).groupBy(F.col("event_type").alias("mode"), (F.col("user_id") % 10).alias("grid")).agg(F.sum("pnl").alias("profit"), F.count("*").alias("bets"), F.max("value").alias("worst")).where("bets >= 20")
    order = F.struct((-F.round(F.col("profit") / F.col("bets"), 9)).alias("a"), "worst", (-F.col("bets")).alias("c"), "grid")
    return g.groupBy("mode").agg(F.min_by("grid", order).alias("grid"))


@query("SELECT conv_id, count(DISTINCT text) AS kept, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role <> 'user') AS answered FROM conversations GROUP BY 1")
def t10_distinct_two_way(spark, sf):
    """Distinct entries, and a split in two."""
    user = F.col("role") == "user"
    return table(spark, sf, "conversations").withColumn("h", F.sha2("text", 256)).groupBy("conv_id").agg(F.count_distinct("h").alias("kept"), F.count_if(user).alias("asked"), F.count_if(~user).alias("answered"))
