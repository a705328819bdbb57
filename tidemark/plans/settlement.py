"""Settlement, corrections, change detection, cooldowns and nested sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.bankroll import simulate
from ..operators.linking import roots
from ..sources.tables import table
from .registry import query


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN l_returnflag = 'R' THEN 'void' WHEN l_linestatus = 'F' THEN 'won' ELSE 'lost' END AS status,
  round(CASE WHEN o_orderstatus = 'P' THEN NULL WHEN l_returnflag = 'R' THEN l_quantity WHEN l_linestatus = 'F' THEN l_quantity * (1 + l_discount * 10) ELSE 0 END, 2) AS payout FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""")
def st14_settled_bets(spark, sf):
    """Bets against official results: what is won, lost or void, and what it pays; open events stay pending."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    open_, void, won = F.col("o_orderstatus") == "P", F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    status = F.when(open_, "pending").when(void, "void").when(won, "won").otherwise("lost")
    payout = F.when(open_, None).when(void, F.col("l_quantity")).when(won, F.col("l_quantity") * (1 + F.col("l_discount") * 10)).otherwise(0.0)
    return rows.select("l_orderkey", "l_linenumber", status.alias("status"), F.round(payout, 2).alias("payout"))


@query("""
WITH b AS (SELECT l_orderkey, count(*) AS bets, count(*) FILTER (l_returnflag = 'N') AS open FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN bets IS NULL THEN 'no_bets' WHEN o_orderstatus = 'P' AND open > 0 THEN 'review' WHEN o_totalprice < 5000 THEN 'void' ELSE 'settle' END AS action FROM orders LEFT JOIN b ON l_orderkey = o_orderkey
""")
def st15_review_or_settle(spark, sf):
    """What is done with an event's bets: review goes before void, void before settlement."""
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("bets"), F.count_if(F.col("l_returnflag") == "N").alias("open"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").join(b, "o_orderkey", "left")
    action = F.when(F.col("bets").isNull(), "no_bets").when((F.col("o_orderstatus") == "P") & (F.col("open") > 0), "review").when(F.col("o_totalprice") < 5000, "void")
    return rows.select("o_orderkey", action.otherwise("settle").alias("action"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def st20_insert_once(spark, sf):
    """The first record of each key; later ones are no inserts."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


_RANK = "CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'view' THEN 1 ELSE 0 END"


@query(f"SELECT user_id, max({{'r': {_RANK}, 't': ts, 'i': event_id}}).i AS event_id FROM events GROUP BY 1")
def st22_strongest_correction(spark, sf):
    """Of the corrections of a result the strongest source's newest; a weaker one never replaces it."""
    rank = F.expr(_RANK)
    best = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct(rank.alias("r"), "ts", F.col("event_id").alias("event_id"))).alias("b"))
    return best.select("user_id", "b.event_id")


@query("""
SELECT event_id, CASE WHEN ts < max(ts) OVER w THEN 'history' WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) > INTERVAL 6 HOUR THEN 'interrupted' ELSE 'current' END AS goes_to
FROM (SELECT event_id, user_id, ts - CASE WHEN event_type = 'error' THEN INTERVAL 8 HOUR ELSE INTERVAL 0 HOUR END AS ts FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)
""")
def st7_late_rows(spark, sf):
    """Rows older than what was seen go to history only; a long silence is an interruption."""
    seen = F.when(F.col("event_type") == "error", F.col("ts") - F.expr("interval 8 hours")).otherwise(F.col("ts"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    top = F.max("t").over(w.rowsBetween(Window.unboundedPreceding, 0))
    e = table(spark, sf, "events").select("event_id", "user_id", seen.alias("t")).withColumn("top", top).withColumn("before", F.lag("t").over(w))
    goes = F.when(F.col("t") < F.col("top"), "history").when(F.col("t") - F.expr("interval 6 hours") > F.col("before"), "interrupted").otherwise("current")
    return e.select("event_id", goes.alias("goes_to"))


@query("""
SELECT event_id, event_type, price, prev, price - prev AS change FROM (SELECT event_id, event_type, CAST(floor(value / 50) AS BIGINT) AS price, lag(CAST(floor(value / 50) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events)
WHERE prev IS NULL OR prev <> price
""")
def st9_price_changes(spark, sf):
    """A row where a market's price is new or has changed, with the change."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", F.floor(F.col("value") / 50).alias("price")).withColumn("prev", F.lag("price").over(w))
    return rows.where("prev is null or prev <> price").select("event_id", "event_type", "price", "prev", (F.col("price") - F.col("prev")).alias("change"))


@query("""
WITH RECURSIVE h AS (SELECT DISTINCT user_id, epoch_us(ts) // 3600000000 AS h FROM events WHERE event_type = 'click'), r AS (SELECT user_id, min(h) AS h FROM h GROUP BY 1 UNION ALL SELECT r.user_id, min(h.h) FROM r JOIN h ON h.user_id = r.user_id AND h.h >= r.h + 48 GROUP BY r.user_id, r.h)
SELECT user_id, count(*) AS runs, max(h) AS last_hour FROM r GROUP BY 1
""")
def st10_cooldown(spark, sf):
    """Requests that pass a cooldown of 48 hours; the fold goes over a key's distinct hours."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    hours = table(spark, sf, "events").where("event_type = 'click'").groupBy("user_id").agg(F.sort_array(F.collect_set(hour)).alias("h"))
    zero = F.struct(F.lit(0).cast("long").alias("runs"), F.lit(None).cast("long").alias("last"))
    ran = F.aggregate("h", zero, lambda s, h: F.when(s["last"].isNull() | (h >= s["last"] + 48), F.struct((s["runs"] + 1).alias("runs"), h.alias("last"))).otherwise(s))
    return hours.select("user_id", ran.alias("r")).select("user_id", "r.runs", F.col("r.last").alias("last_hour"))


@query()
def st17_bankroll(spark, sf):
    """Bets of each account with cash, exposure, due payments and new beginnings."""
    e = table(spark, sf, "events")
    bets = e.select(
        F.col("user_id").alias("account"), F.col("event_id").alias("bet"), (F.col("event_id") % 25).alias("event"), F.col("ts").alias("placed"),
        (F.col("ts") + F.expr("interval 1 day")).alias("settles"), (1 + F.col("value") / 100).alias("odds"), (F.col("value") > 150).alias("won"),
    )
    return simulate(bets)


#: Gate sets that are tried: least edge, and the highest price that is taken.
GATES = [(edge, most) for edge in (0.0, 0.05, 0.1) for most in (2.0, 3.0, 6.0)]


@query()
def w36_gate_simulations(spark, sf):
    """The same candidates through each of nine gate sets: bets, rejections, turnover and new beginnings.

    Every account has a bank of its own in each gate set, so no task sees the whole table.
    """
    e = table(spark, sf, "events")
    p = F.get_json_object("props", "$.k").cast("int") / 100.0
    gates = F.explode(F.array(*[F.struct(F.lit(i).alias("gate"), F.lit(edge).alias("edge"), F.lit(most).alias("most")) for i, (edge, most) in enumerate(GATES)])).alias("g")
    rows = e.select("event_id", "user_id", (F.col("event_id") % 25).alias("event"), "ts", (1 + F.col("value") / 100).alias("odds"), p.alias("p"), gates).select("*", "g.*")
    rows = rows.where("p * odds - 1 >= edge and odds <= most")
    bets = rows.select(
        (F.col("user_id") * len(GATES) + F.col("gate")).alias("account"), F.col("event_id").alias("bet"), "event", F.col("ts").alias("placed"), (F.col("ts") + F.expr("interval 1 day")).alias("settles"), "odds", (F.col("event_id") % 3 == 0).alias("won")
    )
    done = simulate(bets)
    by = done.groupBy("account").agg(F.count_if("accepted").alias("bets"), F.count_if(~F.col("accepted")).alias("rejected"), F.sum("stake").alias("turnover"), F.max("resets").alias("resets"))
    return by.groupBy((F.col("account") % len(GATES)).cast("int").alias("gate")).agg(*[F.sum(c).alias(c) for c in ("bets", "rejected", "turnover", "resets")])


@query("SELECT o_orderkey, l_linenumber, (l_linenumber = 1 AND o_orderstatus = 'F') OR l_linestatus = 'F' AS closes FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 3")
def st24_set_bets(spark, sf):
    """Set bets meet their own set's result as soon as it is there."""
    sets = table(spark, sf, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_linestatus")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    closes = ((F.col("l_linenumber") == 1) & (F.col("o_orderstatus") == "F")) | (F.col("l_linestatus") == "F")
    return o.join(sets, "o_orderkey").select("o_orderkey", "l_linenumber", closes.alias("closes"))


_FEED = """concat('{"id": ', event_id, ', "markets": [{"name": "', event_type, '", "prices": [', CAST(floor(value) AS BIGINT), ', ', event_id % 100, ']}, {"name": "total", "prices": []}', CASE WHEN event_id % 3 = 0 THEN ', {"name": "set", "prices": [7]}' ELSE '' END, ']}')"""


@query(f"""
WITH j AS (SELECT from_json({_FEED}, '{{"id": "BIGINT", "markets": [{{"name": "VARCHAR", "prices": ["BIGINT"]}}]}}') AS j FROM events), m AS (SELECT j.id AS id, unnest(j.markets) AS m FROM j),
p AS (SELECT id, m.name AS market, m.prices AS prices, unnest(range(1, len(m.prices) + 1)) AS i FROM m)
SELECT id, market, i - 1 AS selection, prices[i] AS price FROM p
""")
def src2_nested_feed(spark, sf):
    """A nested feed flattened to one row a price; markets without prices give none."""
    kind = "struct<id: long, markets: array<struct<name: string, prices: array<long>>>>"
    feed = table(spark, sf, "events").select(F.from_json(F.expr(_FEED), kind).alias("j"))
    m = feed.select("j.id", F.explode("j.markets").alias("m"))
    return m.select("id", F.col("m.name").alias("market"), F.posexplode("m.prices").alias("selection", "price")).withColumn("selection", F.col("selection").cast("long"))


_PARENT = "CASE WHEN c_custkey % 40 = 0 THEN NULL WHEN c_custkey % 211 = 5 THEN c_custkey + 1 ELSE c_custkey - 1 END"


@query(f"""
WITH RECURSIVE n AS (SELECT c_custkey AS id, {_PARENT} AS parent FROM customer),
up AS (SELECT id, id AS node, parent, 0 AS depth FROM n UNION ALL SELECT up.id, n.id, n.parent, depth + 1 FROM up JOIN n ON n.id = up.parent WHERE depth < 300),
r AS (SELECT id, min(depth) AS depth, arg_min(node, depth) AS root FROM up WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n) GROUP BY 1)
SELECT id, CAST(depth AS INTEGER) AS depth, root, root IS NULL AS in_cycle FROM n LEFT JOIN r USING (id)
""")
def src4_root_of_tree(spark, sf):
    """Depth and root of each node of any depth, and the nodes whose way up ends in a cycle."""
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr(_PARENT).alias("parent"))
    return roots(nodes)


@query("""
WITH s AS (SELECT DISTINCT doc_id FROM labels) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s) AND (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)) >= 100
""")
def src18_pending(spark, sf):
    """What is not done yet, if it is enough for a run."""
    left = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_anti")
    enough = F.broadcast(left.agg((F.count("*") >= 100).alias("enough")))  # one row
    return left.join(enough).where("enough").select("doc_id")


@query("SELECT o_orderkey, sha256('{\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}') AS digest FROM orders")
def src33_json_lines_digest(spark, sf):
    """JSON lines with their keys in order, each with its digest."""
    line = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))
    return table(spark, sf, "orders").select("o_orderkey", F.sha2(line, 256).alias("digest"))
