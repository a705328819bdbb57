"""Point-in-time and matching joins on the driver's tables.

``events`` stands for quotes and states: user_id is the event's key, event_type the side or state
and value the price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.asof import asof_backward, latest_per_key, visible_versions
from ..sources.tables import table
from .registry import query


def _kind(spark: SparkSession, sf: str, kind: str, **names: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_type") == kind)
    return e.select(*[F.col(c).alias(n) for n, c in names.items()])


@query("""
SELECT l.event_id, l.user_id, l.ts, r.ts AS matched_at, r.value AS price
FROM (SELECT * FROM events WHERE event_type = 'error') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts
""")
def j1_asof_backward(spark, sf):
    """The latest purchase price at or before each error of the user."""
    left = _kind(spark, sf, "error", event_id="event_id", user_id="user_id", ts="ts")
    right = _kind(spark, sf, "purchase", user_id="user_id", at="ts", price="value", rid="event_id")
    return asof_backward(left, right, "user_id", "ts", "at", ["price"], tie="rid")


@query("""
SELECT l.event_id, a.value AS price_a, b.value AS price_b FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF JOIN (SELECT * FROM events WHERE event_type = 'click' AND value > 1) a ON l.user_id = a.user_id AND l.ts >= a.ts
ASOF JOIN (SELECT * FROM events WHERE event_type = 'view' AND value > 1) b ON l.user_id = b.user_id AND l.ts >= b.ts
""")
def j2_asof_two_sides(spark, sf):
    """Both sides' latest valid price at each decision; a decision without both is left out."""
    out = _kind(spark, sf, "purchase", event_id="event_id", user_id="user_id", ts="ts")
    for side, kind in (("price_a", "click"), ("price_b", "view")):
        quotes = _kind(spark, sf, kind, user_id="user_id", at="ts", rid="event_id", **{side: "value"}).where(F.col(side) > 1)
        out = asof_backward(out, quotes, "user_id", "ts", "at", [side], tie="rid").drop("matched_at")
    return out.where("price_a is not null and price_b is not null").select("event_id", "price_a", "price_b")


@query("""
SELECT l.event_id, coalesce(r.value, CAST(0 AS DOUBLE)) AS last_price, r.value IS NULL AS is_missing
FROM (SELECT * FROM events WHERE event_type = 'signup') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase' AND CAST(json_extract(props, '$.k') AS INTEGER) >= 50) r
ON l.user_id = r.user_id AND l.ts >= r.ts
""")
def j4_asof_with_defaults(spark, sf):
    """The latest decision that has the wanted key, else neutral defaults."""
    right = table(spark, sf, "events").where("event_type = 'purchase' and cast(get_json_object(props, '$.k') as int) >= 50")
    left = _kind(spark, sf, "signup", event_id="event_id", user_id="user_id", ts="ts")
    out = asof_backward(left, right.select("user_id", F.col("ts").alias("at"), F.col("value").alias("price"), F.col("event_id").alias("rid")), "user_id", "ts", "at", ["price"], tie="rid")
    return out.select("event_id", F.coalesce("price", F.lit(0.0)).alias("last_price"), F.col("price").isNull().alias("is_missing"))


@query("""
SELECT l.event_id, r.value AS fill, (epoch_us(l.due) - epoch_us(r.ts)) // 1000000 AS staleness
FROM (SELECT *, ts + INTERVAL 2 HOUR AS due FROM events WHERE event_type = 'purchase') l
ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.due >= r.ts
""")
def j6_asof_after_latency(spark, sf):
    """The quote that stands a fixed latency after the decision, and how old it is then."""
    left = _kind(spark, sf, "purchase", event_id="event_id", user_id="user_id", ts="ts").withColumn("due", F.expr("ts + interval 2 hours"))
    right = _kind(spark, sf, "click", user_id="user_id", at="ts", fill="value", rid="event_id")
    out = asof_backward(left, right, "user_id", "due", "at", ["fill"], tie="rid").where("matched_at is not null")
    age = F.expr("unix_micros(cast(due as timestamp)) - unix_micros(cast(matched_at as timestamp))")
    return out.select("event_id", "fill", F.floor(age / 1000000).alias("staleness"))


@query("""
SELECT l.event_id, CASE WHEN r.ts >= l.ts - INTERVAL 12 HOUR THEN r.value END AS price
FROM (SELECT * FROM events WHERE event_type = 'error') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts
""")
def j7_asof_max_age(spark, sf):
    left = _kind(spark, sf, "error", event_id="event_id", user_id="user_id", ts="ts")
    right = _kind(spark, sf, "view", user_id="user_id", at="ts", price="value", rid="event_id")
    return asof_backward(left, right, "user_id", "ts", "at", ["price"], tie="rid", max_age="12 hours").select("event_id", "price")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY s.available DESC, o.o_orderkey DESC) AS n
  FROM orders o JOIN (SELECT l_orderkey, max(l_shipdate) AS available FROM lineitem GROUP BY 1) s ON s.l_orderkey = o.o_orderkey
  WHERE o.o_orderdate <= TIMESTAMP '1999-01-01' AND s.available <= TIMESTAMP '2000-01-01')
WHERE n = 1
""")
def j8_bitemporal(spark, sf):
    """The newest version that had happened and was known by the cutoffs."""
    known = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("available"))
    rows = table(spark, sf, "orders").where("o_orderdate <= timestamp_ntz '1999-01-01'").join(known, "o_orderkey")
    rows = rows.select("o_custkey", "o_orderkey", "o_totalprice", "available", F.lit(0).alias("zero"))
    cutoff = F.expr("timestamp_ntz '2000-01-01'")
    return visible_versions(rows, ["o_custkey"], "available", "available", cutoff, "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
SELECT least(l_partkey % 50, l_suppkey % 50) AS low, greatest(l_partkey % 50, l_suppkey % 50) AS high, count(*) AS n FROM lineitem GROUP BY 1, 2
""")
def j16_unordered_pair(spark, sf):
    """Order-independent pair key."""
    a, b = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    return table(spark, sf, "lineitem").groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(F.count("*").alias("n"))


@query("""
SELECT c.c_custkey, CASE WHEN count(s.s_suppkey) = 1 THEN min(s.s_suppkey) END AS s_suppkey
FROM customer c LEFT JOIN supplier s ON s.s_nationkey = c.c_nationkey GROUP BY 1
""")
def j17_unique_match(spark, sf):
    """The match if it is the only one, else none. Candidates are counted before the join."""
    only = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("s_suppkey").alias("n"), F.min("s_suppkey").alias("s_suppkey")).where("n = 1")
    return table(spark, sf, "customer").join(only, F.col("c_nationkey") == F.col("s_nationkey"), "left").select("c_custkey", "s_suppkey")


@query("""
SELECT s_nationkey AS alias, min(s_suppkey) AS owner FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1
""")
def j20_single_owner(spark, sf):
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("alias")).agg(F.min("s_suppkey").alias("owner"), F.max("s_suppkey").alias("other"))
    return s.where("owner = other").select("alias", "owner")


@query("""
SELECT e.event_id, count(h.event_id) AS matches, (2 + count(h.event_id) FILTER (h.value >= 35)) / CAST(4 + 2 + count(h.event_id) AS DOUBLE) AS win_rate
FROM events e LEFT JOIN events h ON h.user_id = e.user_id AND h.ts <= e.ts AND h.event_id <> e.event_id GROUP BY 1
""")
def j23_history_with_prior(spark, sf):
    """Wins over matches known by each time, own event excluded, with a (2, 4) prior: one window, no range join."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    won = F.when(F.col("value") >= 35, 1).otherwise(0)
    rows = table(spark, sf, "events").withColumn("matches", F.count("*").over(w) - 1).withColumn("wins", F.sum(won).over(w) - won)
    return rows.select("event_id", "matches", ((2 + F.col("wins")) / (6 + F.col("matches"))).alias("win_rate"))


@query("""
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
WHERE n = 1 AND event_type <> 'error'
""")
def j26_newest_decision_wins(spark, sf):
    """The latest record is picked before its status is looked at, so a revocation hides what it revoked."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return latest_per_key(e, ["user_id"], ["ts", "event_id"]).where("event_type <> 'error'").select("user_id", "event_id", "value")


@query("""
SELECT user_id, min_by(event_id, (CASE WHEN value > 100 THEN 1 ELSE 0 END, ts, event_id)) AS event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1
""")
def j31_least_by_struct(spark, sf):
    """The row with the fewest faults, then the earliest, before the label time."""
    e = table(spark, sf, "events").where("ts < timestamp_ntz '2024-01-20'")
    return e.groupBy("user_id").agg(F.min_by("event_id", F.struct(F.when(F.col("value") > 100, 1).otherwise(0), "ts", "event_id")).alias("event_id"))


@query("""
SELECT a.p_brand AS brand_a, b.p_brand AS brand_b, CASE WHEN abs(length(a.p_brand) - length(b.p_brand)) > 1 THEN 9 ELSE levenshtein(a.p_brand, b.p_brand) END AS distance
FROM (SELECT DISTINCT p_brand FROM part) a JOIN (SELECT DISTINCT p_brand FROM part) b ON a.p_brand < b.p_brand
""")
def j34_edit_distance(spark, sf):
    """Edit distance of the few distinct names, 9 if their lengths differ by more than one."""
    names = table(spark, sf, "part").select("p_brand").distinct()
    a, b = names.select(F.col("p_brand").alias("brand_a")), names.select(F.col("p_brand").alias("brand_b"))
    far = F.abs(F.length("brand_a") - F.length("brand_b")) > 1
    pairs = a.join(b, F.col("brand_a") < F.col("brand_b"))
    return pairs.select("brand_a", "brand_b", F.when(far, 9).otherwise(F.levenshtein("brand_a", "brand_b")).cast("long").alias("distance"))
