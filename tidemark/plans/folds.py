"""Chronological folds of rows and of whole entities, and checks that no future leaks into them.

``orders`` stands for matches (they begin with the order and end with the last shipment) and ``events``
for samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import series as S
from ..operators.ranking import ranked
from ..sources.tables import table
from .registry import query

_MATCHES = "SELECT o_orderkey AS id, o_orderdate AS a, max(l_shipdate) AS z FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"


def matches(spark, sf) -> DataFrame:
    """id, a (begin), z (end) of each match that has an end."""
    ends = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("z"))
    return table(spark, sf, "orders").join(ends, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("a"), "z")


def crosses(cut: str, gap: str = "interval 0 days") -> Column:
    """Whether a match lies on the cut or nearer to it than the gap."""
    return F.expr(f"a < {cut} + {gap} and z > {cut} - {gap}")


@query(f"""
WITH m AS ({_MATCHES}), r AS (SELECT *, row_number() OVER (ORDER BY a, id) AS k, count(*) OVER () AS n FROM m),
c AS (SELECT a AS cut FROM r WHERE k = n - 199), e AS (SELECT id, a, z, a < cut + INTERVAL 30 DAY AND z > cut - INTERVAL 30 DAY AS wide, a < cut AND z > cut AS touch FROM r, c WHERE k <= n - 200),
g AS (SELECT count(*) FILTER (NOT wide) >= 8 AS fits FROM e), l AS (SELECT id, a, z FROM e, g WHERE NOT CASE WHEN fits THEN wide ELSE touch END),
q AS (SELECT *, row_number() OVER (ORDER BY a, id) AS k, count(*) OVER () AS n FROM l), v AS (SELECT *, n - least(greatest(1, round_even(n * 0.25, 0)), n - 1) AS t FROM q),
d AS (SELECT a AS cut FROM v WHERE k = t + 1), b AS (SELECT id, a < cut + INTERVAL 30 DAY AND z > cut - INTERVAL 30 DAY AS wide, a < cut AND z > cut AS touch FROM v, d WHERE k <= t),
h AS (SELECT count(*) FILTER (NOT wide) >= 1 AS fits FROM b)
SELECT id, 'test' AS part FROM r WHERE k > n - 200 UNION ALL SELECT id, 'validation' FROM v WHERE k > t UNION ALL SELECT id, 'train' FROM b, h WHERE NOT CASE WHEN fits THEN wide ELSE touch END
""")
def w29_cut_with_embargo(spark, sf):
    """The latest 200 matches test; earlier ones that cross a cut, or lie within 30 days of it, are dropped.

    If that leaves too few, only those on the cut itself are. A quarter of the earlier matches, the
    last, validate.
    """
    by = ["a", "id"]

    def before(rows: DataFrame, cut: DataFrame, least: int) -> DataFrame:
        rows = rows.crossJoin(F.broadcast(cut)).select("id", "a", "z", crosses("cut", "interval 30 days").alias("wide"), crosses("cut").alias("touch"))
        fits = rows.agg((F.count_if(~F.col("wide")) >= least).alias("fits"))
        return rows.crossJoin(F.broadcast(fits)).where("not if(fits, wide, touch)").select("id", "a", "z")

    r = ranked(matches(spark, sf), by, total="n")
    earlier = before(r.where("k <= n - 200"), r.where("k = n - 199").select(F.col("a").alias("cut")), 8)
    v = ranked(earlier, by, total="n").withColumn("t", F.expr("n - least(greatest(1, bround(n * 0.25)), n - 1)"))
    train = before(v.where("k <= t"), v.where("k = t + 1").select(F.col("a").alias("cut")), 1)
    part = lambda rows, name: rows.select("id", F.lit(name).alias("part"))
    return part(r.where("k > n - 200"), "test").union(part(v.where("k > t"), "validation")).union(part(train, "train"))


@query(f"""
WITH m AS ({_MATCHES}), s AS (SELECT min(a) AS f, max(a) AS l FROM m), c AS (SELECT f + (l - f) * 0.6 AS c1, f + (l - f) * 0.8 AS c2 FROM s),
p AS (SELECT id, CASE WHEN a < c1 THEN 'train' WHEN a < c2 THEN 'validation' ELSE 'test' END AS part,
  (a < c1 + INTERVAL 30 DAY AND z > c1 - INTERVAL 30 DAY) OR (a < c2 + INTERVAL 30 DAY AND z > c2 - INTERVAL 30 DAY) AS wide, (a < c1 AND z > c1) OR (a < c2 AND z > c2) AS touch FROM m, c),
g AS (SELECT count(DISTINCT part) FILTER (NOT wide) = 3 AS fits FROM p)
SELECT id, part FROM p, g WHERE NOT CASE WHEN fits THEN wide ELSE touch END
""")
def w30_time_fraction_cut(spark, sf):
    """Cuts at 60 and 80 % of the time covered; a match stays whole, and one that crosses a cut is dropped.

    If an embargo of 30 days leaves a part empty, only the matches on a cut are dropped.
    """
    m = matches(spark, sf)
    span = F.broadcast(m.agg(F.min("a").alias("f"), F.max("a").alias("l")).selectExpr("f + (l - f) * 0.6 as c1", "f + (l - f) * 0.8 as c2"))
    gap = "interval 30 days"
    rows = m.crossJoin(span).select(
        "id", F.expr("case when a < c1 then 'train' when a < c2 then 'validation' else 'test' end").alias("part"),
        (crosses("c1", gap) | crosses("c2", gap)).alias("wide"), (crosses("c1") | crosses("c2")).alias("touch"),
    )
    left = rows.where("not wide").groupBy("part").count().agg((F.count("*") == 3).alias("fits"))
    return rows.crossJoin(F.broadcast(left)).where("not if(fits, wide, touch)").select("id", "part")


_W25 = """
WITH r AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS k, count(*) OVER () AS n FROM events), f AS (SELECT unnest([0, 1, 2, 3]) AS fold),
b AS (SELECT fold, (fold + 1) * (n // 5) AS lo, CASE WHEN fold < 3 THEN (fold + 2) * (n // 5) ELSE n END AS hi FROM f, (SELECT DISTINCT n FROM r)),
c AS (SELECT b.*, ts AS start FROM b JOIN r ON k = lo),
x AS (SELECT event_id, fold, ts, CASE WHEN k >= lo THEN 'test' ELSE 'train' END AS part FROM r, c WHERE (k >= lo AND k < hi) OR (k < lo AND ts + INTERVAL 1 HOUR <= start))
"""


def walk_forward(rows: DataFrame, time: str, key: str, splits: int = 4, purge: str = "interval 1 hour", rolling: bool = False) -> DataFrame:
    """``rows`` once for each fold they take part in, with fold and part: growing or rolling training parts before equal test parts.

    A row nearer to the first time of the test part than ``purge`` is not trained on.
    """
    r = ranked(rows, [time, key], "_k", total="_n").withColumn("_k", F.col("_k") - 1)
    chunk = f"(_n div {splits + 1})"
    first = r.where(f"_k > 0 and _k % {chunk} = 0 and _k div {chunk} <= {splits}").select((F.expr(f"_k div {chunk}") - 1).alias("fold"), F.col(time).alias("_start"))
    r = r.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)).cast("array<bigint>"))).join(F.broadcast(first), "fold")
    low, high = f"(fold + 1) * {chunk}", f"if(fold < {splits - 1}, (fold + 2) * {chunk}, _n)"
    least = f"fold * {chunk}" if rolling else "0"
    part = F.expr(f"case when _k >= {low} and _k < {high} then 'test' when _k < {low} and _k >= {least} and {time} + {purge} <= _start then 'train' end")
    return r.withColumn("part", part).where("part is not null").drop("_k", "_n", "_start")


@query(_W25 + "SELECT event_id, fold, part FROM x")
def w25_purged_folds(spark, sf):
    """Four expanding folds over samples in order of time, with an hour purged before each test part."""
    return walk_forward(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", F.col("fold").cast("int").alias("fold"), "part")


@query(_W25 + """SELECT fold, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'test') AS n_test, count(*) - count(DISTINCT event_id) AS twice,
max(ts) FILTER (part = 'train') + INTERVAL 1 HOUR <= min(ts) FILTER (part = 'test') AS apart FROM x GROUP BY 1""")
def w26_fold_leakage(spark, sf):
    """For each fold: rows in both parts, and whether all training ends an hour before the test begins."""
    x = walk_forward(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id").withColumn("fold", F.col("fold").cast("int"))
    side = lambda p, c: F.when(F.col("part") == p, F.col(c))
    twice = x.groupBy("fold", "event_id").agg(F.count("*").alias("c")).groupBy("fold").agg(F.sum(F.col("c") - 1).alias("twice"))
    ends = x.groupBy("fold").agg(
        F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test"), F.max(side("train", "ts")).alias("a"), F.min(side("test", "ts")).alias("b")
    )
    return ends.join(twice, "fold").select("fold", "n_train", "n_test", "twice", F.expr("a + interval 1 hour <= b").alias("apart"))


@query("""
SELECT max(o_orderdate) FILTER (o_orderdate < TIMESTAMP '1996-01-01') + INTERVAL 7 DAY <= min(o_orderdate) FILTER (o_orderdate >= TIMESTAMP '1996-01-05') AS intact,
  count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-05' AND o_orderdate >= TIMESTAMP '1996-01-01') AS purged FROM orders
""")
def u17_split_integrity(spark, sf):
    """Whether the last training time and a purge of a week lie before the first validation time."""
    train, valid = "o_orderdate < timestamp_ntz '1996-01-01'", "o_orderdate >= timestamp_ntz '1996-01-05'"
    end, begin = (f(F.when(F.expr(c), F.col("o_orderdate"))) for f, c in ((F.max, train), (F.min, valid)))
    rows = table(spark, sf, "orders").agg(end.alias("e"), begin.alias("b"), F.count_if(~F.expr(train) & ~F.expr(valid)).alias("purged"))
    return rows.select(F.expr("e + interval 7 days <= b").alias("intact"), "purged")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, o_orderdate AS decided, o_orderdate + to_days(l_linenumber - 2) AS filled, l_shipdate AS settled, o_orderdate + to_days(CAST(l_quantity AS INTEGER) % 4 - 2) AS quoted
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, CASE WHEN decided > filled THEN 'FILLED_BEFORE_DECISION' WHEN quoted > filled THEN 'QUOTE_AFTER_FILL' WHEN filled >= settled THEN 'SETTLED_BEFORE_FILL' END AS broken FROM t
""")
def u18_execution_causality(spark, sf):
    """The first rule that the times of decision, quote, fill and settlement break."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("decided"))
    t = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    t = t.withColumn("filled", F.expr("decided + make_interval(0, 0, 0, l_linenumber - 2)")).withColumn("quoted", F.expr("decided + make_interval(0, 0, 0, cast(l_quantity as int) % 4 - 2)"))
    broken = F.expr("case when decided > filled then 'FILLED_BEFORE_DECISION' when quoted > filled then 'QUOTE_AFTER_FILL' when filled >= l_shipdate then 'SETTLED_BEFORE_FILL' end")
    return t.select("l_orderkey", "l_linenumber", broken.alias("broken"))


_U16 = "count(*) OVER w AS n, coalesce(value - first(value) OVER w, 0) AS delta FROM {t} WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)"


@query(f"""
WITH past AS (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-15'), a AS (SELECT event_id, {_U16.format(t='past')}), b AS (SELECT event_id, ts, {_U16.format(t='events')}),
c AS (SELECT event_id, n, delta FROM b WHERE ts <= TIMESTAMP '2024-01-15')
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM c)) AS only_before, (SELECT count(*) FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM a)) AS only_with_future
""")
def u16_future_changes_nothing(spark, sf):
    """Features of the past must be the same whether the future is there or not: rows on one side only."""
    w = Window.partitionBy("user_id").orderBy(S.micros("ts")).rangeBetween(-86400 * S.MICROS, 0)

    def features(rows: DataFrame) -> DataFrame:
        return rows.select("event_id", "ts", F.count("*").over(w).alias("n"), F.coalesce(F.col("value") - F.first("value").over(w), F.lit(0.0)).alias("delta"))

    past = "ts <= timestamp_ntz '2024-01-15'"
    e = table(spark, sf, "events")
    a, b = features(e.where(past)).drop("ts"), features(e).where(past).drop("ts")
    # Rows are counted by value on both sides, one grouping in place of two set differences.
    both = a.withColumn("d", F.lit(1)).union(b.withColumn("d", F.lit(-1))).groupBy("event_id", "n", "delta").agg(F.sum("d").alias("d"))
    return both.agg(F.sum(F.greatest(F.col("d"), F.lit(0))).alias("only_before"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("only_with_future"))


@query("""
WITH k AS (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderdate), o_custkey) - 1 AS k, count(*) OVER () AS n, min(o_orderdate) AS first FROM orders GROUP BY 1),
f AS (SELECT o_custkey, first, CAST(k * 4 // n AS INTEGER) AS fold FROM k), s AS (SELECT fold - 1 AS fold, min(first) AS next FROM f GROUP BY 1),
l AS (SELECT l_orderkey, max(l_shipdate) AS known FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderpriority AS target, f.fold, known <= next AS admitted FROM orders JOIN f USING (o_custkey) LEFT JOIN s ON s.fold = f.fold LEFT JOIN l ON l_orderkey = o_orderkey
""")
def w42_shared_folds(spark, sf):
    """Folds of whole customers that all targets share; a row may be trained on if its outcome was known when the next fold began."""
    o = table(spark, sf, "orders")
    f = ranked(o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first")), ["first", "o_custkey"], total="n")
    f = f.select("o_custkey", "first", F.expr("cast((k - 1) * 4 div n as int)").alias("fold"))
    begins = f.groupBy((F.col("fold") - 1).alias("fold")).agg(F.min("first").alias("next"))  # a row a fold
    known = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("known"))
    rows = o.join(f.drop("first"), "o_custkey").join(F.broadcast(begins), "fold", "left").join(known, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.col("o_orderpriority").alias("target"), "fold", (F.col("known") <= F.col("next")).alias("admitted"))


@query("""
WITH e AS (SELECT event_id, user_id, ts, CAST(json_extract(props, '$.k') AS INTEGER) / 100.0::DOUBLE AS p FROM events),
s AS (SELECT *, CASE WHEN p * 1.9 - 1 >= 0.03 THEN 'a' WHEN (1 - p) * 1.9 - 1 >= 0.03 THEN 'b' END AS side FROM e),
c AS (SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM s),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY ts, event_id) AS run FROM i),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM r WHERE side IS NOT NULL AND run = 2)
SELECT user_id, event_id, side FROM h WHERE n = 1
""")
def w45_confirmed_forecasts(spark, sf):
    """The first sample of each event at which a forecast has named one side with enough edge twice in a row."""
    p = F.get_json_object("props", "$.k").cast("int") / F.lit(100.0)
    side = F.when(p * 1.9 - 1 >= 0.03, "a").when((1 - p) * 1.9 - 1 >= 0.03, "b")
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", side.alias("side"))
    return S.confirmations(rows, "user_id", ["ts", "event_id"], "side", 2).select("user_id", "event_id", "side")


@query("""
WITH e AS (SELECT event_id, user_id, ts, event_type AS reason, value > 150 AS eligible, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' END AS side, date_trunc('hour', ts) AS shot FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, shot ORDER BY ts, event_id) AS k, lag(reason) OVER w AS r, lag(eligible) OVER w AS g,
  last_value(side) OVER (PARTITION BY user_id, shot ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM e WINDOW w AS (PARTITION BY user_id, shot ORDER BY ts, event_id)),
s AS (SELECT event_id, user_id, shot, side, eligible, lag(final) OVER (PARTITION BY user_id ORDER BY shot) AS prior FROM o WHERE k = 1),
i AS (SELECT *, sum(CASE WHEN side = prior THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY shot ROWS UNBOUNDED PRECEDING) AS i FROM s),
c AS (SELECT *, CASE WHEN side IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY user_id, i ORDER BY shot) END AS agree FROM i)
SELECT o.event_id, CASE WHEN o.k = 1 THEN CASE WHEN c.side = c.prior AND c.eligible AND c.agree >= 2 THEN 'commit' ELSE 'watch' END WHEN o.reason = o.r AND o.eligible = o.g THEN 'unchanged' ELSE 'refresh' END AS action
FROM o LEFT JOIN c ON o.event_id = c.event_id
""")
def w15_watch_actions(spark, sf):
    """What each reading of a snapshot does: nothing, refresh it, watch a side, or commit to it.

    The first reading of a snapshot counts agreement with the side that the snapshot before ended
    with; a side is committed to when two snapshots running name it and this one is eligible. Later
    readings of the same snapshot change nothing, or refresh reason, eligibility and side.
    """
    side = F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "view", "b")
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("reason"), (F.col("value") > 150).alias("eligible"), side.alias("side"), F.date_trunc("hour", "ts").alias("shot"))
    w = Window.partitionBy("user_id", "shot").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = e.withColumn("k", F.row_number().over(w)).withColumn("same", (F.lag("reason").over(w) == F.col("reason")) & (F.lag("eligible").over(w) == F.col("eligible"))).withColumn("final", F.last("side").over(whole))
    shots = Window.partitionBy("user_id").orderBy("shot")
    s = o.where("k = 1").withColumn("prior", F.lag("final").over(shots))
    agrees = F.coalesce(F.col("side") == F.col("prior"), F.lit(False))
    s = s.withColumn("i", F.sum(F.when(agrees, 0).otherwise(1)).over(shots.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.row_number().over(Window.partitionBy("user_id", "i").orderBy("shot"))
    first = s.select("event_id", F.when(agrees & F.col("eligible") & (F.col("side").isNotNull()) & (run >= 2), "commit").otherwise("watch").alias("action"))
    later = o.where("k > 1").select("event_id", F.when(F.col("same"), "unchanged").otherwise("refresh").alias("action"))
    return first.union(later)


@query("""
WITH e AS (SELECT event_id, user_id, ts, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events), s AS (SELECT *, k % 5 AS a, k // 5 % 5 AS b FROM e),
l AS (SELECT event_id, a, b, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN (a <> pa) = (b <> pb) THEN NULL WHEN a <> pa THEN CASE WHEN pa = 4 AND a = 3 AND pb = 3 THEN 'b' WHEN a = pa + 1 THEN 'a' END
  ELSE CASE WHEN pb = 4 AND b = 3 AND pa = 3 THEN 'a' WHEN b = pb + 1 THEN 'b' END END AS winner FROM l
""")
def w47_point_winner(spark, sf):
    """Who won the point between two charted scores (0 to 3, 4 for advantage): only one side may change, by one step.

    An advantage that is lost at 40 is the other side's point.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    w = S.by_time("user_id", "ts", "event_id")
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", (k % 5).alias("a"), (F.floor(k / 5) % 5).cast("int").alias("b"))
    rows = rows.withColumn("pa", F.lag("a").over(w)).withColumn("pb", F.lag("b").over(w))

    def step(now: str, was: str, other: str, mine: str, theirs: str) -> Column:
        lost = (F.col(was) == 4) & (F.col(now) == 3) & (F.col(other) == 3)
        return F.when(lost, theirs).when(F.col(now) == F.col(was) + 1, mine)

    a, b = F.col("a") != F.col("pa"), F.col("b") != F.col("pb")
    return rows.select("event_id", F.when(a & ~b, step("a", "pa", "pb", "a", "b")).when(b & ~a, step("b", "pb", "pa", "b", "a")).alias("winner"))
