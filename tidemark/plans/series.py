"""Windows over event histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series as S
from ..operators.ranking import ranked
from ..sources.tables import table
from .registry import query

WIDTHS = {"6h": 21600, "12h": 43200, "1d": 86400, "2d": 172800, "4d": 345600}


def _trailing_sql() -> str:
    cols, windows = [], []
    for n, s in WIDTHS.items():
        cols.append(
            f"value - first(value) OVER w{n} AS delta_{n}, (value - first(value) OVER w{n}) / {s}.0 AS speed_{n}, "
            f"coalesce(stddev_samp(value) OVER w{n}, 0) AS vol_{n}, count(value) OVER w{n} AS n_{n}"
        )
        windows.append(f"w{n} AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {s} SECOND PRECEDING AND CURRENT ROW)")
    return f"SELECT event_id, {', '.join(cols)} FROM events WINDOW {', '.join(windows)}"


@query(_trailing_sql())
def w6_trailing_features(spark, sf):
    """Five trailing windows of four statistics each, from one sort."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return S.trailing_features(rows, "user_id", "ts", "event_id", "value", WIDTHS).drop("user_id", "ts", "value")


@query("""
SELECT event_id, CASE WHEN d IS NULL THEN 'new' WHEN d > 0.01 THEN 'up' WHEN d < -0.01 THEN 'down' ELSE 'flat' END AS move
FROM (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
""")
def w4_direction(spark, sf):
    """The sign of the change from the row before, with a dead band."""
    d = F.col("value") - F.col("_p.value")
    move = F.when(d.isNull(), "new").when(d > 0.01, "up").when(d < -0.01, "down").otherwise("flat")
    return S.previous(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", move.alias("move"))


@query("""
SELECT user_id, CASE WHEN v > 1 THEN v ELSE CAST(0 AS DOUBLE) END AS last_price FROM (SELECT user_id, max_by(value, (ts, event_id)) AS v FROM events GROUP BY 1)
""")
def w5_last_record_price(spark, sf):
    """The last record's price, 0 if that one is no price: earlier ones are not looked at."""
    last = F.max_by("value", F.struct("ts", "event_id"))
    return table(spark, sf, "events").groupBy("user_id").agg(last.alias("v")).select("user_id", F.when(F.col("v") > 1, F.col("v")).otherwise(0.0).alias("last_price"))


_STREAK = """
WITH a AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM events),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM a),
s AS (SELECT event_id, user_id, ts, event_type, row_number() OVER (PARTITION BY user_id, i ORDER BY ts, event_id) AS streak FROM b)
"""


@query(_STREAK + "SELECT event_id, CAST(streak AS INTEGER) AS streak FROM s")
def w7_streaks(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return S.streaks(rows, "user_id", ["ts", "event_id"], "event_type").select("event_id", "streak")


@query(_STREAK + "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM s WHERE streak = 3) WHERE n = 1")
def w14_confirmation(spark, sf):
    """The first event of each user with the same type three times in a row."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return S.confirmations(rows, "user_id", ["ts", "event_id"], "event_type", 3).select("user_id", "event_id", "event_type")


@query("""
SELECT event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) AS suspended FROM events
""")
def w8_suspended_in_window(spark, sf):
    w = Window.partitionBy("user_id", "_slice").orderBy("_u").rangeBetween(-172800 * S.MICROS, 0)
    rows = S.with_context(table(spark, sf, "events"), "user_id", "ts", 172800)
    return rows.select("event_id", F.count_if(F.col("event_type") == "error").over(w).alias("suspended"), "_own").where("_own").drop("_own")


@query("""
SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p
""")
def w10_changes_only(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return S.changes_only(rows, "user_id", ["ts", "event_id"], ["event_type"]).select("event_id")


@query("""
SELECT user_id, greatest(min(ts) FILTER (event_type = 'click'), min(ts) FILTER (event_type = 'view')) AS both_seen FROM events GROUP BY 1
HAVING count(*) FILTER (event_type = 'click') > 0 AND count(*) FILTER (event_type = 'view') > 0
""")
def w11_both_sides_seen(spark, sf):
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    both = table(spark, sf, "events").groupBy("user_id").agg(first("click").alias("a"), first("view").alias("b")).where("a is not null and b is not null")
    return both.select("user_id", F.greatest("a", "b").alias("both_seen"))


@query("""
WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT r.*, s, s * (n - 1) / 11.0 AS x FROM r, range(12) t(s)),
c AS (SELECT *, CASE WHEN x - floor(x) = 0.5 THEN 2 * round(x / 2) ELSE round(x) END AS want FROM k)
SELECT DISTINCT event_id FROM c WHERE n <= 12 OR want = i
""")
def w12_even_sample(spark, sf):
    """Twelve rows of each user at even steps, both ends included."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return S.even_sample(rows, "user_id", ["ts", "event_id"], 12).select("event_id")


@query("""
SELECT user_id, event_type AS side, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type DESC) AS k FROM events GROUP BY 1, 2) WHERE k = 1
""")
def w17_leading_side(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    best = n.groupBy("user_id").agg(F.max(F.struct("n", F.col("event_type").alias("side"))).alias("b"))
    return best.select("user_id", "b.side", "b.n")


@query("""
WITH e AS (SELECT user_id, ts, event_id, sum(round((value - 50) * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS equity FROM events),
p AS (SELECT *, max(equity) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM e)
SELECT user_id, CAST(max(peak - equity) AS BIGINT) AS worst, max(CASE WHEN peak > 0 THEN (peak - equity) / CAST(peak AS DOUBLE) ELSE 0 END) AS worst_share FROM p GROUP BY 1
""")
def w18_drawdown(spark, sf):
    """The deepest fall from the running peak, in cents and as a share, each on its own."""
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", F.round((F.col("value") - 50) * 100).cast("long").alias("pnl"))
    return S.drawdown(rows, "user_id", ["ts", "event_id"], "pnl").groupBy("user_id").agg(F.max("fall").alias("worst"), F.max("fall_share").alias("worst_share"))


@query("""
SELECT event_id, k, p AS last_k FROM (
  SELECT event_id, k, last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
  FROM (SELECT *, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events))
WHERE k < p
""")
def w20_clock_regression(spark, sf):
    """Rows whose clock is behind the last clock that was known; nulls neither count nor reset."""
    k = F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("int"))
    rows = S.last_known(table(spark, sf, "events").withColumn("k", k), "user_id", ["ts", "event_id"], {"last_k": F.col("k")}, current=False)
    return rows.where("k < last_k").select("event_id", "k", "last_k")


@query("""
SELECT event_id, (epoch_us(ts) - epoch_us(p)) // 1000000 AS gap FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE epoch_us(ts) - epoch_us(p) > 86400000000
""")
def w21_gaps(spark, sf):
    rows = S.previous(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "ts")
    rows = rows.select("event_id", (S.micros("ts") - S.micros("_p.ts")).alias("gap")).where("gap > 86400000000")
    return rows.select("event_id", F.floor(F.col("gap") / 1000000).alias("gap"))


@query("""
WITH a AS (SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS cents, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM events)
SELECT event_id, CAST(sum(cents) OVER (PARTITION BY user_id, i ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM a
""")
def w24_ledger(spark, sf):
    """Running balance in cents that a deposit starts anew."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return S.ledger(rows, "user_id", ["ts", "event_id"], "cents", F.col("event_type") == "signup").select("event_id", "balance")


@query("""
SELECT user_id, CAST(floor(4 * (k - 1) / CAST(n AS DOUBLE)) AS INTEGER) AS fold FROM (
  SELECT user_id, row_number() OVER (ORDER BY first, user_id) AS k, count(*) OVER () AS n FROM (SELECT user_id, min(ts) AS first FROM events GROUP BY 1))
""")
def w28_whole_event_folds(spark, sf):
    """Chronological folds that keep an event whole; the ranks go over ranges of first times."""
    first = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first"))
    return ranked(first, ["first", "user_id"], total="n").select("user_id", F.floor(4 * (F.col("k") - 1) / F.col("n")).cast("int").alias("fold"))


@query("""
SELECT date_trunc('hour', ts) AS hour, max(value) FILTER (event_type = 'click') AS a, max(value) FILTER (event_type = 'view') AS b, bool_or(event_type = 'error') AS suspended FROM events GROUP BY 1
""")
def w33_pivot_sides(spark, sf):
    side = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")
    return table(spark, sf, "events").groupBy(hour).agg(side("click").alias("a"), side("view").alias("b"), F.bool_or(F.col("event_type") == "error").alias("suspended"))


@query("""
SELECT user_id, avg(value) FILTER (k <= 10) AS last10, avg(value) FILTER (k <= 20) AS last20, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS n_7, count(*) FILTER (ts >= TIMESTAMP '2024-01-01') AS n_30,
  count(*) FILTER (ts >= TIMESTAMP '2023-11-02') AS n_90, count(*) FILTER (ts >= TIMESTAMP '2023-01-31') AS n_365
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-01-31') GROUP BY 1
""")
def w34_recent_form(spark, sf):
    """Means of the last 10 and 20 rows and counts of the last 7, 30, 90 and 365 days as of a time."""
    now = "timestamp_ntz '2024-01-31'"
    rows = table(spark, sf, "events").where(f"ts <= {now}")
    days = [F.count_if(F.expr(f"ts >= {now} - interval {n} days")).alias(f"n_{n}") for n in (7, 30, 90, 365)]
    # Only a user's last twenty rows of each task go to the window; the counts are added up in the tasks.
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    newest = rows.select("user_id", "ts", "event_id", "value").withColumn("k", k).where("k <= 20")
    last = lambda n: F.avg(F.when(F.col("k") <= n, F.col("value"))).alias(f"last{n}")
    return rows.groupBy("user_id").agg(*days).join(newest.groupBy("user_id").agg(last(10), last(20)), "user_id").select("user_id", "last10", "last20", *[f"n_{n}" for n in (7, 30, 90, 365)])


@query("""
SELECT conv_id, turn, len(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS seen,
  array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ',') AS roles FROM conversations
""")
def w38_earlier_sequence(spark, sf):
    """For each turn the sequence of roles up to it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    seq = F.collect_list("role").over(w)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(seq).cast("long").alias("seen"), F.array_join(seq, ",").alias("roles"))
