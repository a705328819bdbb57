"""Links, eligibility rules and relational forms on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.asof import asof_backward, latest_per_key
from ..operators.linking import contained, duplicates, first_near, near_in_time, only_candidate, similarity, span_clusters
from ..sources.tables import table
from .registry import query

_K = "CAST(json_extract(props, '$.k') AS INTEGER)"


def _of(spark, sf, kind, **columns):
    return table(spark, sf, "events").where(F.col("event_type") == kind).select(*[F.col(c).alias(n) for n, c in columns.items()])


def _k():
    return F.get_json_object("props", "$.k").cast("int")


@query("""
SELECT l.event_id, array_to_string(list_filter([CASE WHEN c.value IS NOT NULL THEN 'click=' || CAST(CAST(round(c.value * 100) AS BIGINT) AS VARCHAR) END, CASE WHEN v.value IS NOT NULL THEN 'view=' || CAST(CAST(round(v.value * 100) AS BIGINT) AS VARCHAR) END,
  CASE WHEN s.value IS NOT NULL THEN 'signup=' || CAST(CAST(round(s.value * 100) AS BIGINT) AS VARCHAR) END], lambda x: x IS NOT NULL), ',') AS book FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON l.user_id = c.user_id AND l.ts >= c.ts
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON l.user_id = v.user_id AND l.ts >= v.ts
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON l.user_id = s.user_id AND l.ts >= s.ts
""")
def j3_book_as_of(spark, sf):
    """The whole book at each decision: the latest price of every market that has one."""
    out, markets = _of(spark, sf, "purchase", event_id="event_id", user_id="user_id", ts="ts"), ("click", "view", "signup")
    for m in markets:
        out = asof_backward(out, _of(spark, sf, m, user_id="user_id", at="ts", rid="event_id", **{m: "value"}), "user_id", "ts", "at", [m], tie="rid").drop("matched_at")
    quotes = [F.when(F.col(m).isNotNull(), F.concat(F.lit(m + "="), F.round(F.col(m) * 100).cast("long"))) for m in markets]
    return out.select("event_id", F.concat_ws(",", *quotes).alias("book"))


@query("""
SELECT l.event_id, r.value AS price FROM (SELECT * FROM events WHERE event_type = 'error') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view' AND value BETWEEN 20 AND 300) r ON l.user_id = r.user_id AND l.ts >= r.ts
""")
def j5_latest_valid_quote(spark, sf):
    """Quotes that are not valid are passed over, not taken as missing."""
    valid = _of(spark, sf, "view", user_id="user_id", at="ts", rid="event_id", price="value").where("price between 20 and 300")
    return asof_backward(_of(spark, sf, "error", event_id="event_id", user_id="user_id", ts="ts"), valid, "user_id", "ts", "at", ["price"], tie="rid").select("event_id", "price")


@query("""
SELECT a.event_id, min(b.event_id) AS matched FROM (SELECT *, 'u' || user_id AS name FROM events WHERE event_type = 'signup') a JOIN (SELECT *, 'team u' || user_id AS name FROM events WHERE event_type = 'error') b
ON abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 43200000000 AND (contains(b.name, a.name) OR contains(a.name, b.name)) GROUP BY 1
""")
def j11_contained_names(spark, sf):
    """The first record near in time whose name holds the other's."""
    a = _of(spark, sf, "signup", event_id="event_id", ts="ts", user="user_id").withColumn("name", F.concat(F.lit("u"), "user"))
    b = _of(spark, sf, "error", other="event_id", at="ts", user_b="user_id").withColumn("name_b", F.concat(F.lit("team u"), "user_b"))
    # Rows meet under the name that the other one holds: each under its own, and under the other side's names that stand in it.
    # way 0: the record's name stands in the other's; 1: the other's in the record's.
    in_b, in_a = contained(b, "name_b", a, "name"), contained(a, "name", b, "name_b")
    left = a.select("event_id", "ts", F.col("name").alias("part"), F.lit(0).alias("way")).union(a.join(in_a, "name").select("event_id", "ts", "part", F.lit(1)))
    right = b.join(in_b, "name_b").select("other", "at", "part", F.lit(0).alias("way")).union(b.select("other", "at", F.col("name_b"), F.lit(1)))
    found = first_near(left, right, "ts", "at", 43200, ["part", "way"], "other")
    return found.groupBy("event_id").agg(F.min("other").alias("matched")).where("matched is not null")


@query("""
WITH r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS vid, user_id, ts AS seen FROM events WHERE event_type = 'view'),
c AS (SELECT r.event_id, 0 AS rank, vid FROM r JOIN v ON vid = r.event_id + 1 UNION ALL SELECT r.event_id, 1, vid FROM r JOIN v ON r.user_id = v.user_id AND abs(epoch_us(seen) - epoch_us(ts)) <= 21600000000)
SELECT event_id, min({'rank': rank, 'vid': vid}).vid AS vid, min(rank) AS rank FROM c GROUP BY 1
""")
def j12_by_id_else_near(spark, sf):
    """A match by id goes before one by participant and time."""
    r = _of(spark, sf, "purchase", event_id="event_id", user_id="user_id", ts="ts")
    v = _of(spark, sf, "view", vid="event_id", viewer="user_id", at="ts")
    by_id = r.join(v, F.col("vid") == F.col("event_id") + 1).select("event_id", F.lit(0).alias("rank"), "vid")
    near = near_in_time(r, v.withColumnRenamed("viewer", "user_id"), "ts", "at", 21600, ("user_id",)).select("event_id", F.lit(1).alias("rank"), "vid")
    best = by_id.union(near).groupBy("event_id").agg(F.min(F.struct("rank", "vid")).alias("b"))
    return best.select("event_id", "b.vid", "b.rank")


@query("""
WITH RECURSIVE d AS (SELECT DISTINCT o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day FROM orders),
s AS (SELECT o_custkey, o_orderpriority, min(day) AS start FROM d GROUP BY ALL UNION ALL
  SELECT s.o_custkey, s.o_orderpriority, min(d.day) FROM s JOIN d ON d.o_custkey = s.o_custkey AND d.o_orderpriority = s.o_orderpriority AND d.day > s.start + 14 GROUP BY s.o_custkey, s.o_orderpriority, s.start)
SELECT o_orderkey, CAST(max(start) AS VARCHAR) AS cluster_start FROM orders o JOIN s USING (o_custkey, o_orderpriority) WHERE start <= o_orderdate GROUP BY 1
""")
def j15_span_clusters(spark, sf):
    """Records of one pair within 14 days of the first are one match."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    out = span_clusters(rows, ["o_custkey", "o_orderpriority"], "day", 14)
    return out.select("o_orderkey", F.col("cluster_start").cast("string").alias("cluster_start"))


@query("""
SELECT a.l_orderkey, a.l_linenumber, count(*) AS matches FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_quantity = b.l_quantity AND a.l_suppkey <> b.l_suppkey AND abs(date_diff('day', a.l_shipdate, b.l_shipdate)) <= 200 GROUP BY ALL
""")
def j18_compound_equality(spark, sf):
    """Facts of two sources that agree in all of several respects."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey", F.to_date("l_shipdate").alias("day"))
    # Facts are counted first: rows meet a day's count of a seller, not each other.
    other = rows.groupBy("l_partkey", "l_quantity", F.col("l_suppkey").alias("s2"), F.col("day").alias("d2")).agg(F.count("*").alias("n"))
    pairs = rows.join(other, ["l_partkey", "l_quantity"]).where((F.col("l_suppkey") != F.col("s2")) & (F.abs(F.date_diff("day", "d2")) <= 200))
    return pairs.groupBy("l_orderkey", "l_linenumber").agg(F.sum("n").alias("matches"))


@query("""
WITH n AS (SELECT s_nationkey AS nation, s_suppkey % 4 AS part, min(s_suppkey) AS id FROM supplier GROUP BY ALL HAVING count(DISTINCT s_suppkey) = 1), o AS (SELECT s_nationkey AS nation, min(s_suppkey) AS id FROM supplier GROUP BY ALL HAVING count(DISTINCT s_suppkey) = 1)
SELECT c_custkey, coalesce(n.id, o.id) AS link, CASE WHEN n.id IS NOT NULL THEN 1.0 WHEN o.id IS NOT NULL THEN 0.6 END::DOUBLE AS confidence FROM customer LEFT JOIN n ON c_nationkey = n.nation AND c_custkey % 4 = n.part LEFT JOIN o ON c_nationkey = o.nation
""")
def j19_named_else_surname(spark, sf):
    """The only full match, else the only partial one with less confidence; several are none."""
    s = table(spark, sf, "supplier")
    full = only_candidate(s.select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 4).alias("part"), F.col("s_suppkey").alias("full_id")), ["nation", "part"], "full_id")
    part = only_candidate(s.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("part_id")), ["nation"], "part_id")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 4).alias("part"))
    confidence = F.when(F.col("full_id").isNotNull(), 1.0).when(F.col("part_id").isNotNull(), 0.6)
    return c.join(full, ["nation", "part"], "left").join(part, "nation", "left").select("c_custkey", F.coalesce("full_id", "part_id").alias("link"), confidence.alias("confidence"))


@query("""
SELECT l.event_id, CASE WHEN r.value <= 200 THEN r.event_id END AS owner FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') r ON l.user_id = r.user_id AND l.ts >= r.ts
""")
def j21_owner_as_of(spark, sf):
    """The owner by the newest decision of the log; a revocation leaves none."""
    log = _of(spark, sf, "signup", user_id="user_id", at="ts", rid="event_id", value="value")
    out = asof_backward(_of(spark, sf, "purchase", event_id="event_id", user_id="user_id", ts="ts"), log, "user_id", "ts", "at", ["rid", "value"], tie="rid")
    return out.select("event_id", F.when(F.col("value") <= 200, F.col("rid")).alias("owner"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 15) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def j22_both_resolve(spark, sf):
    """Rows of which both participants are confirmed."""
    parts = table(spark, sf, "part").where("p_size < 15").select(F.col("p_partkey").alias("l_partkey"))
    sellers = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.join(parts, "l_partkey", "left_semi").join(sellers, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""
WITH h AS (SELECT l_partkey % 40 AS a, l_suppkey % 40 AS b, count(*) AS n, avg(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT x.a, x.b, x.n, x.q - y.q AS gap, x.n = y.n AS consistent FROM h x JOIN h y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b
""")
def j28_reciprocal_pairs(spark, sf):
    """Both sides of a pair, their difference, and whether the two records of their meetings agree."""
    h = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 40).alias("a"), (F.col("l_suppkey") % 40).alias("b")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"))
    back = h.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"), F.col("q").alias("r"))
    return h.join(back, ["a", "b"]).where("a < b").select("a", "b", "n", (F.col("q") - F.col("r")).alias("gap"), (F.col("n") == F.col("m")).alias("consistent"))


@query("""
WITH f AS (SELECT user_id, CAST(floor(arg_max(value, {'ts': ts, 'id': event_id}) / 100) AS BIGINT) AS score FROM events GROUP BY 1)
SELECT user_id, min(ts) AS first_seen FROM events JOIN f USING (user_id) WHERE CAST(floor(value / 100) AS BIGINT) = score GROUP BY 1
""")
def j32_first_with_final_score(spark, sf):
    """The first record that shows what turned out to be the final state."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", F.floor(F.col("value") / 100).alias("score"))
    final = e.groupBy("user_id").agg(F.max_by("score", F.struct("ts", "event_id")).alias("final"))
    return e.join(final, "user_id").where("score = final").groupBy("user_id").agg(F.min("ts").alias("first_seen"))


@query("""
WITH n AS (SELECT DISTINCT p_type, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
m AS (SELECT x.p_type, x.p_name AS left_name, y.p_name AS right_name, 1 - levenshtein(x.a, y.a) / greatest(length(x.a), length(y.a), 1)::DOUBLE AS d1, 1 - levenshtein(x.b, y.b) / greatest(length(x.b), length(y.b), 1)::DOUBLE AS d2,
  1 - levenshtein(x.a, y.b) / greatest(length(x.a), length(y.b), 1)::DOUBLE AS s1, 1 - levenshtein(x.b, y.a) / greatest(length(x.b), length(y.a), 1)::DOUBLE AS s2 FROM n x JOIN n y ON x.p_type = y.p_type AND x.b[1] = y.b[1] AND x.p_name < y.p_name)
SELECT p_type, left_name, right_name, greatest(least(d1, d2), least(s1, s2)) AS score FROM m WHERE greatest(least(d1, d2), least(s1, s2)) >= 0.4
""")
def j33_pair_similarity(spark, sf):
    """Two names against two names, straight and crossed; the worse of each pairing counts. Distinct names only."""
    n = table(spark, sf, "part").select("p_type", "p_name").distinct().select("p_type", "p_name", F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b")).withColumn("i", F.substring("b", 1, 1))
    y = n.select("p_type", "i", F.col("p_name").alias("right_name"), F.col("a").alias("c"), F.col("b").alias("d"))
    s = lambda p, q: similarity(F.col(p), F.col(q))
    score = F.greatest(F.least(s("a", "c"), s("b", "d")), F.least(s("a", "d"), s("b", "c")))
    return n.join(y, ["p_type", "i"]).where("p_name < right_name").select("p_type", F.col("p_name").alias("left_name"), "right_name", score.alias("score")).where("score >= 0.4")


@query("SELECT p_partkey, CASE WHEN first <> p_partkey THEN first END AS duplicate_of FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type) AS first FROM part)")
def j35_duplicate_of(spark, sf):
    """Records of one identity: the smallest id survives."""
    return duplicates(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type"), ["p_name", "p_brand", "p_type"], "p_partkey").select("p_partkey", "duplicate_of")


@query("SELECT p_partkey, contains(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), lower(substr(p_type, 1, 5))) OR contains(lower(substr(p_type, 1, 5)), regexp_replace(lower(split_part(p_name, ' ', 1)), '[^a-z]', '', 'g')) AS match FROM part")
def j29_contained_either_way(spark, sf):
    """Normalised names of which one holds the other."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    kind = F.lower(F.substring("p_type", 1, 5))
    return table(spark, sf, "part").select("p_partkey", (bare(F.col("p_name")).contains(kind) | kind.contains(bare(F.split("p_name", " ")[0]))).alias("match"))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'retired' WHEN value < 20 THEN 'incomplete' WHEN conflict THEN 'label_conflict' END AS reason
FROM (SELECT *, count(DISTINCT value > 250) OVER (PARTITION BY user_id, CAST(ts AS DATE)) > 1 AS conflict FROM events)
""")
def fil4_exclusion_reason(spark, sf):
    """Why a match is not learnt from; the first of three reasons."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    sides = e.groupBy("user_id", "day").agg((F.min(F.col("value") > 250) != F.max(F.col("value") > 250)).alias("conflict"))
    reason = F.when(F.col("event_type") == "error", "retired").when(F.col("value") < 20, "incomplete").when(F.col("conflict"), "label_conflict")
    return e.join(sides, ["user_id", "day"]).select("event_id", reason.alias("reason"))


@query(f"""
SELECT event_id FROM events WHERE event_type <> 'error' AND ((event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 90 MINUTE AND ts <= TIMESTAMP '2024-01-30') OR (event_type = 'signup' AND ts BETWEEN TIMESTAMP '2024-01-30' AND TIMESTAMP '2024-01-30' + INTERVAL 6 HOUR)) AND {_K} <> 50
""")
def fil2_eligible_events(spark, sf):
    """Live and seen lately, or about to start; the time bounds reach the scan."""
    at = "timestamp_ntz '2024-01-30'"
    live = f"event_type in ('click', 'view') and ts >= {at} - interval 90 minutes and ts <= {at}"
    soon = f"event_type = 'signup' and ts between {at} and {at} + interval 6 hours"
    return table(spark, sf, "events").where(f"event_type <> 'error' and (({live}) or ({soon}))").where(_k() != 50).select("event_id")


_POLICY = {"match": (0.03, 0.55), "set": (0.05, None), "": (0.02, 0.5)}


@query(f"""
WITH p(family, min_edge, min_p) AS (VALUES ('match', 0.03::DOUBLE, 0.55::DOUBLE), ('set', 0.05, NULL)), e AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'match' WHEN event_type = 'click' THEN 'set' ELSE event_type END AS family FROM events)
SELECT event_id, coalesce(min_edge, 0.02::DOUBLE) AS min_edge, coalesce(min_p, 0.5::DOUBLE) AS min_p FROM e LEFT JOIN p USING (family)
""")
def fil7_limits_with_fallback(spark, sf):
    """Limits of the market's family, each with the shared value where it has none."""
    rows = [(f, *v) for f, v in _POLICY.items() if f]
    policy = F.broadcast(spark.createDataFrame(rows, "family string, min_edge double, min_p double"))  # one row a family
    family = F.when(F.col("event_type") == "view", "match").when(F.col("event_type") == "click", "set").otherwise(F.col("event_type"))
    e = table(spark, sf, "events").select("event_id", family.alias("family"))
    fallback = _POLICY[""]
    return e.join(policy, "family", "left").select("event_id", F.coalesce("min_edge", F.lit(fallback[0])).alias("min_edge"), F.coalesce("min_p", F.lit(fallback[1])).alias("min_p"))


@query("""
SELECT event_id, CASE WHEN finished THEN 'finished' WHEN number <> current THEN 'not_in_play' WHEN number > 3 THEN 'beyond' ELSE 'ok' END AS verdict
FROM (SELECT event_id, event_id % 5 + 1 AS number, user_id % 5 + 1 AS current, event_type = 'purchase' AS finished FROM events)
""")
def fil17_set_in_play(spark, sf):
    """Only the set that is being played, and not one that is over."""
    n, current = F.col("event_id") % 5 + 1, F.col("user_id") % 5 + 1
    verdict = F.when(F.col("event_type") == "purchase", "finished").when(n != current, "not_in_play").when(n > 3, "beyond").otherwise("ok")
    return table(spark, sf, "events").select("event_id", verdict.alias("verdict"))


@query("""
WITH b AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30'), t AS (SELECT user_id, max(ts) AS last FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1)
SELECT user_id FROM t WHERE user_id NOT IN (SELECT user_id FROM b) AND (SELECT count(*) FROM b) > 0
""")
def fil20_retired_by_live_board(spark, sf):
    """Rows that a current board no longer lists; an empty board retires nothing."""
    e = table(spark, sf, "events").select("user_id", "ts")
    board = e.where("ts >= timestamp_ntz '2024-01-30'").select("user_id").distinct()
    gone = e.where("ts < timestamp_ntz '2024-01-30'").select("user_id").distinct().join(board, "user_id", "left_anti")
    current = board.agg((F.count("*") > 0).alias("current"))  # one row
    return gone.join(F.broadcast(current)).where("current").select("user_id")


@query(f"SELECT event_type, count(*) AS n, bool_and(ok) AS ready, array_to_string(list_filter(['size', 'price', 'known'], lambda g: (g = 'size' AND count(*) < 100) OR (g = 'price' AND max(value) > 700) OR (g = 'known' AND bool_or(k IS NULL))), ',') AS blocked_by FROM (SELECT *, {_K} AS k, value > 0 AS ok FROM events) GROUP BY 1")
def fil27_named_gates(spark, sf):
    """Named gates over a group; those that fail are listed."""
    g = table(spark, sf, "events").withColumn("k", _k()).groupBy("event_type").agg(
        F.count("*").alias("n"), F.bool_and(F.col("value") > 0).alias("ready"), F.max("value").alias("top"), F.bool_or(F.col("k").isNull()).alias("unknown"))
    gates = [F.when(F.col("n") < 100, "size"), F.when(F.col("top") > 700, "price"), F.when(F.col("unknown"), "known")]
    return g.select("event_type", "n", "ready", F.concat_ws(",", *gates).alias("blocked_by"))


@query("SELECT o_custkey, o_orderpriority, max(o_orderkey) AS latest FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def q2_latest_per_composite(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderkey").alias("latest"))


@query("""
SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '1996-01-01') AS evidence FROM customer
""")
def q4_outer_evidence(spark, sf):
    """The latest evidence by a time for every row; rows without any keep null."""
    o = table(spark, sf, "orders").where("o_orderdate <= timestamp_ntz '1996-01-01'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("evidence"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT c_custkey, 'F' FROM customer WHERE c_acctbal > 9500)")
def q5_batch_probe(spark, sf):
    """Rows of a batch of composite keys."""
    keys = table(spark, sf, "customer").where("c_acctbal > 9500").select(F.col("c_custkey").alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus").join(keys, ["o_custkey", "o_orderstatus"], "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS priority_place FROM orders")
def q7_ranking_windows(spark, sf):
    by = Window.partitionBy("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", F.rank().over(by.orderBy(F.desc("o_totalprice"))).cast("long").alias("place"), F.dense_rank().over(by.orderBy("o_orderpriority")).cast("long").alias("priority_place"))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F' AND l_shipdate >= o_orderdate)")
def q18_not_done(spark, sf):
    """Rows without a later, finished counterpart."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    done = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select("l_orderkey", "l_shipdate")
    return o.join(done, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")), "left_anti").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%' OR p_brand LIKE 'Brand#1_'")
def q28_like(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").ilike("%RING%") | F.col("p_brand").like("Brand#1_")).select("p_partkey")


@query("SELECT to_json(map_from_entries(list((event_type, n) ORDER BY event_type))) AS counts FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def q35_counts_as_map(spark, sf):
    """Counts by group as one map."""
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n"))))).alias("counts"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority, year(o_orderdate) AS y FROM orders")
def q36_distinct_projection(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y")).distinct()


@query("""
WITH a AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), b AS (SELECT c_nationkey, avg(total) AS mean FROM a JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT n_name, round(mean, 4) AS mean FROM b JOIN nation ON n_nationkey = c_nationkey WHERE mean > (SELECT avg(mean) FROM b)
""")
def q38_chained(spark, sf):
    """Aggregates of aggregates against their own mean."""
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    b = a.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.avg("total").alias("mean"))
    over = F.broadcast(b.agg(F.avg("mean").alias("_all")))  # one row
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return b.join(over).where("mean > _all").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", F.round("mean", 4).alias("mean"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1996-06-01', 500) ORDER BY o_orderdate, o_orderkey LIMIT 100")
def q39_keyset_page(spark, sf):
    """The page after a key; the bound reaches the scan."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    at = "timestamp_ntz '1996-06-01'"
    return o.where(f"o_orderdate >= {at} and (o_orderdate > {at} or o_orderkey > 500)").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("SELECT event_type, count(*) AS kept FROM events WHERE NOT (ts < TIMESTAMP '2024-01-11' AND event_type <> 'purchase') GROUP BY 1")
def q41_delete_by_age(spark, sf):
    """What a conditional deletion by age leaves."""
    return table(spark, sf, "events").where("not (ts < timestamp_ntz '2024-01-11' and event_type <> 'purchase')").groupBy("event_type").agg(F.count("*").alias("kept"))
