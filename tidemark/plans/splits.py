"""Folds, holdouts, causal purges, frame-to-frame rules and fixed-length histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from ..operators.series import by_time, last_known, previous
from ..sources.tables import table
from .registry import query


def _ranked(rows, key: str, time: str):
    """Keys with k, their place by first time (from 0), and n, their number."""
    first = rows.groupBy(key).agg(F.min(time).alias("first"))
    return ranked(first, ["first", key], total="n").select(key, (F.col("k") - 1).alias("k"), "n")


@query("""
WITH m AS (SELECT o_custkey, row_number() OVER (ORDER BY first, o_custkey) - 1 AS k, count(*) OVER () AS n FROM (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1)),
f AS (SELECT unnest([0, 1, 2, 3]) AS fold), b AS (SELECT *, (fold + 1) * (n // 5) AS a, CASE WHEN fold < 3 THEN (fold + 2) * (n // 5) ELSE n END AS z FROM m, f)
SELECT o_custkey, fold, CASE WHEN k < greatest(1, a - 3) THEN 'train' ELSE 'test' END AS part FROM b WHERE k < greatest(1, a - 3) OR (k >= a AND k < z)
""")
def w27_walk_forward_folds(spark, sf):
    """Four expanding folds over whole entities, three of them left out before each test part."""
    rows = _ranked(table(spark, sf, "orders"), "o_custkey", "o_orderdate").withColumn("fold", F.explode(F.expr("sequence(0, 3)")))
    rows = rows.withColumn("a", F.expr("(fold + 1) * (n div 5)")).withColumn("z", F.expr("if(fold < 3, (fold + 2) * (n div 5), n)"))
    part = F.expr("case when k < greatest(1, a - 3) then 'train' when k >= a and k < z then 'test' end")
    return rows.select("o_custkey", "fold", part.alias("part")).where("part is not null")


@query("""
WITH m AS (SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY 1),
k AS (SELECT o_custkey, row_number() OVER (ORDER BY newest DESC, o_custkey) AS k FROM m WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
SELECT o_custkey, CASE WHEN k <= 20 THEN 'holdout' WHEN k <= 60 THEN 'search' ELSE 'older' END AS part FROM k
""")
def w31_newest_whole_windows(spark, sf):
    """Newest entities first into windows of fixed size, without the blocked ones."""
    blocked = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    newest = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest")).join(blocked, "o_custkey", "left_anti")
    return ranked(newest, [F.desc("newest"), "o_custkey"]).select("o_custkey", F.expr("case when k <= 20 then 'holdout' when k <= 60 then 'search' else 'older' end").alias("part"))


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS b
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def w32_price_book(spark, sf):
    """The last price of each side at every row."""
    side = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    return last_known(table(spark, sf, "events"), "user_id", ["ts", "event_id"], {"a": side("click"), "b": side("view")}, current=True).select("event_id", "a", "b")


@query("""
WITH r AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT DISTINCT user_id, n, i, CASE WHEN i < 19 THEN CAST(floor(i * ((n - 1) / 19.0::DOUBLE)) AS BIGINT) ELSE n - 1 END AS k FROM (SELECT DISTINCT user_id, n FROM r) , (SELECT unnest(range(20)) AS i) WHERE n > 20)
SELECT user_id, k, value FROM r WHERE n <= 20 UNION ALL SELECT r.user_id, r.k, r.value FROM r JOIN p ON r.user_id = p.user_id AND r.k = p.k
""")
def w37_thinned_curve(spark, sf):
    """Each long curve thinned to 20 points at an even step, the last one always among them."""
    w = by_time("user_id", "ts", "event_id")
    rows = table(spark, sf, "events").select("user_id", "value", (F.row_number().over(w) - 1).cast("long").alias("k"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    # Row k is taken by the i-th point if floor(i * step) = k; only i near k / step can be.
    step = (F.col("n") - 1) / F.lit(19.0)
    i = F.ceil(F.col("k") / step)
    near = [i - 1, i, i + 1]
    hit = F.lit(False)
    for x in near:
        hit = hit | ((x >= 0) & (x < 19) & (F.floor(x * step) == F.col("k")))
    return rows.where((F.col("n") <= 20) | (F.col("k") == F.col("n") - 1) | hit).select("user_id", "k", "value")


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-01-20'),
a AS (SELECT user_id, list(value ORDER BY k DESC) AS l FROM r WHERE k <= 8 GROUP BY 1)
SELECT user_id, array_to_string(list_transform(list_concat(l, list_transform(range(8 - len(l)), lambda x: CAST(0 AS DOUBLE))), lambda x: CAST(round(x) AS BIGINT)), ',') AS states, len(l) AS known FROM a
""")
def w39_padded_states(spark, sf):
    """The newest eight states as of a time, oldest first, padded with zeros."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = table(spark, sf, "events").where("ts <= timestamp_ntz '2024-01-20'").select("user_id", "value", k.alias("k")).where("k <= 8")
    states = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("o"), "value"))).alias("s"))
    states = states.select("user_id", F.col("s.value").alias("v"))
    padded = F.slice(F.concat("v", F.array_repeat(F.lit(0.0), 8)), 1, 8)
    return states.select("user_id", F.array_join(F.transform(padded, lambda x: F.round(x).cast("long")), ",").alias("states"), F.size("v").cast("long").alias("known"))


@query("""
WITH l AS (SELECT o.o_orderkey, o.o_orderdate, max(l.l_shipdate) AS known, count(*) FILTER (l.l_shipdate IS NULL) AS missing FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2)
SELECT o_orderkey FROM l WHERE o_orderdate < TIMESTAMP '1997-01-01' AND missing = 0 AND known <= (SELECT min(o_orderdate) FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')
""")
def w40_causal_purge(spark, sf):
    """Training rows whose outcome was known at the first forecast to be judged; a missing time excludes."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    begin = "timestamp_ntz '1997-01-01'"
    cutoff = F.broadcast(orders.where(f"o_orderdate >= {begin}").agg(F.min("o_orderdate").alias("cutoff")))
    known = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("known"), F.count_if(F.col("l_shipdate").isNull()).alias("missing"))
    train = orders.where(f"o_orderdate < {begin}").join(known, F.col("o_orderkey") == F.col("l_orderkey")).crossJoin(cutoff)
    return train.where("missing = 0 and known <= cutoff").select("o_orderkey")


@query("""
WITH l AS (SELECT o_orderkey, o_orderdate, max(l_shipdate) AS known FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT max(known) FILTER (o_orderdate < TIMESTAMP '1996-01-01') <= min(o_orderdate) FILTER (o_orderdate >= TIMESTAMP '1997-01-01') AS causal, count(*) FILTER (known IS NULL) AS missing FROM l
""")
def w41_causality_check(spark, sf):
    """Whether the last outcome of one part was known before the first forecast of the next."""
    known = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("known"))
    rows = table(spark, sf, "orders").join(known, F.col("o_orderkey") == F.col("l_orderkey"))
    last = F.max(F.when(F.expr("o_orderdate < timestamp_ntz '1996-01-01'"), F.col("known")))
    first = F.min(F.when(F.expr("o_orderdate >= timestamp_ntz '1997-01-01'"), F.col("o_orderdate")))
    return rows.agg((last <= first).alias("causal"), F.count_if(F.col("known").isNull()).alias("missing"))


@query("""
WITH e AS (SELECT event_id, user_id, ts, event_type AS s, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, CASE WHEN p = 'view' AND s = 'click' THEN 'a' WHEN p = 'click' AND s = 'purchase' THEN 'b' END AS winner FROM e
""")
def w46_single_legal_transition(spark, sf):
    """A winner only where the step from the frame before allows exactly one."""
    before, s = F.col("_p.event_type"), F.col("event_type")
    ways = F.array_compact(F.array(F.when((before == "view") & (s == "click"), F.lit("a")), F.when((before == "click") & (s == "purchase"), F.lit("b"))))
    return previous(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", F.when(F.size(ways) == 1, F.element_at(ways, 1)).alias("winner"))


@query("""
WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type AS component, avg(value) > 150 AS up FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2),
c AS (SELECT *, up = lag(up) OVER (PARTITION BY component ORDER BY hour) AS confirmed FROM h)
SELECT hour, count(*) FILTER (confirmed AND up) AS ups, count(*) FILTER (confirmed AND NOT up) AS downs,
  count(*) FILTER (confirmed AND up) = 3 OR count(*) FILTER (confirmed AND NOT up) = 3 AS consensus FROM c GROUP BY 1
""")
def w16_component_consensus(spark, sf):
    """A component confirms a side that it names twice running; all three must confirm one side."""
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")
    kinds = table(spark, sf, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    rows = kinds.groupBy(hour, F.col("event_type").alias("component")).agg((F.avg("value") > 150).alias("up"))
    rows = rows.withColumn("confirmed", F.col("up") == F.lag("up").over(by_time("component", "hour")))
    ups, downs = F.count_if(F.expr("confirmed and up")), F.count_if(F.expr("confirmed and not up"))
    return rows.groupBy("hour").agg(ups.alias("ups"), downs.alias("downs"), ((ups == 3) | (downs == 3)).alias("consensus"))
