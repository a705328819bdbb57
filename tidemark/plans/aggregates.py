"""Metrics, monitoring and performance aggregates.

``lineitem`` and ``orders`` stand for settled bets; events give a probability (value over its
largest) and a label (key over one half) for the calibration metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import table
from .registry import query

_PY = "SELECT event_id, user_id, event_type, least(value / 500, 1) AS p, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) > 50 THEN 1 ELSE 0 END AS y FROM events"


def _forecasts(spark: SparkSession, sf: str) -> DataFrame:
    y = F.when(F.get_json_object("props", "$.k").cast("int") > 50, 1).otherwise(0)
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", F.least(F.col("value") / 500, F.lit(1.0)).alias("p"), y.alias("y"))


@query(f"""
WITH f AS ({_PY}), b AS (SELECT floor(p * 10) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM f WHERE p < 1 GROUP BY 1)
SELECT sum(n * gap) / (SELECT count(*) FROM f) AS ece FROM b
""")
def ag1_ece(spark, sf):
    return M.ece(_forecasts(spark, sf))


@query(f"""
WITH f AS (SELECT *, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM ({_PY}))
SELECT event_type, count(*) AS n, avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END) AS log_loss, avg((p - y) * (p - y)) AS brier,
  avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM f GROUP BY 1
""")
def ag2_scores(spark, sf):
    return M.scores(_forecasts(spark, sf), "event_type")


@query(f"""
WITH f AS ({_PY}), r AS (SELECT y, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) AS rk FROM f),
s AS (SELECT sum(rk) FILTER (y = 1) AS rs, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS neg FROM r)
SELECT (rs - pos * (pos + 1) / 2) / (pos * neg) AS auc FROM s
""")
def ag2_auc(spark, sf):
    return M.auc(_forecasts(spark, sf))


@query(f"""
WITH f AS ({_PY}), b AS (SELECT event_type, CAST(least(floor(p * 5), 4) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM f GROUP BY 1, 2),
k AS (SELECT DISTINCT event_type, CAST(i AS INTEGER) AS bin FROM f, range(5) t(i))
SELECT k.event_type, k.bin, coalesce(n, 0) AS n, mean_p, rate FROM k LEFT JOIN b USING (event_type, bin)
""")
def ag3_calibration(spark, sf):
    """Five bins for each group, the last closed on the right, empty ones included."""
    return M.calibration_bins(_forecasts(spark, sf), 5, ["event_type"])


@query(f"""
WITH f AS ({_PY}), k AS (SELECT p, y, unnest(['all', 'type:' || event_type, CASE WHEN p < 0.1 THEN 'low' ELSE 'high' END]) AS slice FROM f)
SELECT slice, count(*) AS n, avg((p - y) * (p - y)) AS brier, count(DISTINCT y) < 2 AS insufficient FROM k GROUP BY 1
""")
def ag5_overlapping_slices(spark, sf):
    """Each row counts in several slices; the slices are summed on the map side before the shuffle."""
    slices = F.array(F.lit("all"), F.concat(F.lit("type:"), "event_type"), F.when(F.col("p") < 0.1, "low").otherwise("high"))
    rows = _forecasts(spark, sf).select("p", "y", F.explode(slices).alias("slice"))
    sq = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    return rows.groupBy("slice").agg(F.count("*").alias("n"), F.avg(sq).alias("brier"), (F.min("y") == F.max("y")).alias("insufficient"))


@query(f"""
WITH f AS (SELECT p, event_id % 2 = 1 AS c FROM ({_PY})), n AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) FILTER (NOT c) AS a, count(*) FILTER (c) AS b FROM f GROUP BY 1),
t AS (SELECT i AS bin, greatest(coalesce(a, 0) / CAST((SELECT count(*) FROM f WHERE NOT c) AS DOUBLE), 1e-4) AS pa, greatest(coalesce(b, 0) / CAST((SELECT count(*) FROM f WHERE c) AS DOUBLE), 1e-4) AS pb
  FROM range(10) r(i) LEFT JOIN n ON n.bin = i)
SELECT sum((pb - pa) * ln(pb / pa)) AS psi FROM t
""")
def ag15_psi(spark, sf):
    return M.psi(_forecasts(spark, sf).select("p", (F.col("event_id") % 2 == 1).alias("current")))


@query("""
SELECT l_returnflag AS flag, count(*) AS bets, sum(l_extendedprice) AS turnover, sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice * l_discount ELSE -l_extendedprice * l_tax END) AS pnl,
  sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice * l_discount ELSE -l_extendedprice * l_tax END) / sum(l_extendedprice) AS roi, avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS win_rate
FROM lineitem GROUP BY 1
""")
def ag8_performance(spark, sf):
    won = F.col("l_linestatus") == "F"
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice", won.alias("won"), F.when(won, F.col("l_extendedprice") * F.col("l_discount")).otherwise(-F.col("l_extendedprice") * F.col("l_tax")).alias("pnl"))
    return rows.groupBy("flag").agg(
        F.count("*").alias("bets"), F.sum("l_extendedprice").alias("turnover"), F.sum("pnl").alias("pnl"),
        (F.sum("pnl") / F.sum("l_extendedprice")).alias("roi"), F.avg(F.when(F.col("won"), 1.0).otherwise(0.0)).alias("win_rate"),
    )


@query("""
SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS won, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1
""")
def ag21_status_pivot(spark, sf):
    names = {"F": "won", "O": "open", "P": "pending"}
    out = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", list(names)).count()
    return out.select("priority", *[F.coalesce(k, F.lit(0)).alias(v) for k, v in names.items()])


@query("""
SELECT label, count(*) AS n, avg(o_totalprice) AS mean FROM (SELECT unnest(CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN ['all', 'recent'] ELSE ['all'] END) AS label, o_totalprice FROM orders) GROUP BY 1
""")
def ag19_periods(spark, sf):
    labels = F.when(F.expr("o_orderdate >= timestamp_ntz '2001-01-01'"), F.array(F.lit("all"), F.lit("recent"))).otherwise(F.array(F.lit("all")))
    return table(spark, sf, "orders").select(F.explode(labels).alias("label"), "o_totalprice").groupBy("label").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))


@query("""
SELECT user_id, greatest(0, 100 - sum(CASE event_type WHEN 'error' THEN 5 WHEN 'signup' THEN 1 ELSE 0 END)) AS score FROM events GROUP BY 1
""")
def ag22_quality_score(spark, sf):
    penalty = F.when(F.col("event_type") == "error", 5).when(F.col("event_type") == "signup", 1).otherwise(0)
    return table(spark, sf, "events").groupBy("user_id").agg(F.greatest(F.lit(0), 100 - F.sum(penalty)).alias("score"))


@query("SELECT event_type, user_id % 5 AS severity, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 5))")
def ag23_issue_counts(spark, sf):
    """Counts by type and by severity in one pass."""
    rows = table(spark, sf, "events").select("event_type", (F.col("user_id") % 5).alias("severity"))
    return rows.groupingSets([["event_type"], ["severity"]], "event_type", "severity").agg(F.count("*").alias("n"))


@query("""
SELECT user_id, arg_max(event_type, (n, event_type)) AS pick, max(n) / CAST(sum(n) AS DOUBLE) AS share, least(1, sum(n) / 50.0) * (max(n) / CAST(sum(n) AS DOUBLE)) AS confidence
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1
""")
def ag24_consensus(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return n.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("pick"), share.alias("share"), (F.least(F.lit(1.0), F.sum("n") / 50) * share).alias("confidence"))


@query("SELECT event_id, 1.0 / count(*) OVER (PARTITION BY user_id) AS weight FROM events")
def ag26_unit_weight(spark, sf):
    """Each match weighs one in total."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    sizes = e.groupBy(F.col("user_id").alias("u")).agg(F.count("*").alias("n"))
    return e.join(sizes, F.col("user_id").eqNullSafe(F.col("u"))).select("event_id", (F.lit(1.0) / F.col("n")).alias("weight"))


@query("""
SELECT event_type, list_sort(list(value))[CAST(round((count(*) - 1) * 0.5) AS INTEGER) + 1] AS p50, list_sort(list(value))[CAST(round((count(*) - 1) * 0.95) AS INTEGER) + 1] AS p95 FROM events GROUP BY 1
""")
def ag40_nearest_rank(spark, sf):
    """Nearest-rank percentiles. Equal values are counted first and walked in order, so no group is gathered."""
    n = table(spark, sf, "events").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type")
    up = F.sum("c").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    rows = n.select("event_type", "value", up.alias("up"), F.sum("c").over(w).alias("n"))
    at = lambda q: F.min(F.when(F.col("up") >= F.round((F.col("n") - 1) * q) + 1, F.col("value")))
    return rows.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("SELECT c_nationkey, count(*) AS n, sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS wins, CASE WHEN count(*) > 0 THEN sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) END AS win_rate FROM customer GROUP BY 1")
def ag30_win_rates(spark, sf):
    won = F.count_if(F.col("c_acctbal") > 5000)
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), won.alias("wins"), F.try_divide(won, F.count("*")).alias("win_rate"))
