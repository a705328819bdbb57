"""Relational forms and aggregates over bets; ``lineitem`` stands for bets and ``orders`` for matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.asof import latest_per_key
from ..operators.ranking import ranked
from ..sources.tables import table
from .registry import query


@query("""
SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) x
""")
def q3_latest_lookup(spark, sf):
    """The latest order of each customer that has one: combined before the shuffle, not looked up."""
    last = latest_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return table(spark, sf, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("""
WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM benchmark)
SELECT item_id, line_no - 1 AS line_no, word FROM (SELECT item_id, line_no, unnest(string_split(line, ' ')) AS word FROM l) WHERE word <> ''
""")
def q6_nested_explode(spark, sf):
    """Lines, then the words of each line."""
    lines = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("item_id", F.col("line_no").cast("long").alias("line_no"), F.explode(F.split("line", " ")).alias("word")).where("word <> ''")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders")
def q10_sequence_numbers(spark, sf):
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", seq.cast("long").alias("seq"))


@query("SELECT p_partkey, p_brand, p_size FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part) WHERE n = 1")
def q11_unambiguous(spark, sf):
    """Rows whose natural key names them alone."""
    alone = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"), F.min("p_partkey").alias("p_partkey"))
    return alone.where("n = 1").select("p_partkey", "p_brand", "p_size")


@query("SELECT key, role, count(*) AS n FROM (SELECT l_partkey AS key, 'part' AS role FROM lineitem UNION ALL SELECT l_suppkey, 'supplier' FROM lineitem) GROUP BY 1, 2")
def q12_both_sides(spark, sf):
    """Both participants of each row, from one scan."""
    sides = F.explode(F.array(F.struct(F.col("l_partkey").alias("key"), F.lit("part").alias("role")), F.struct(F.col("l_suppkey").alias("key"), F.lit("supplier").alias("role"))))
    return table(spark, sf, "lineitem").select(sides.alias("s")).groupBy("s.key", "s.role").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC), ',') AS orders FROM orders GROUP BY 1")
def q13_ordered_array(spark, sf):
    """The orders of each customer, newest first."""
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")), asc=False).alias("o"))
    return rows.select("o_custkey", F.array_join("o.o_orderkey", ",").alias("orders"))


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def q16_insert_if_absent(spark, sf):
    """What is stored, and incoming rows whose key is not."""
    stored = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    incoming = table(spark, sf, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    return stored.unionByName(incoming.join(stored.select("s_suppkey"), "s_suppkey", "left_anti"))


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def q20_duplicate_groups(spark, sf):
    """Contents that stand more than once; only digests are shuffled."""
    rows = table(spark, sf, "documents").where("text is not null").groupBy(F.md5("text").alias("digest"))
    return rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("""
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open,
  coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0) AS pending FROM orders GROUP BY 1
""")
def q21_filtered_aggregates(spark, sf):
    status = F.col("o_orderstatus")
    pending = F.coalesce(F.sum(F.when(status == "P", F.col("o_totalprice"))), F.lit(0.0))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(status == "F").alias("finished"), F.count_if(status == "O").alias("open"), pending.alias("pending"))


@query("""
SELECT o.o_orderkey FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS s FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
WHERE CASE WHEN s IS NOT NULL THEN 'O' END IS DISTINCT FROM o_orderstatus
""")
def q22_changed_rows(spark, sf):
    """Stored values that differ from the new ones; null is a value."""
    shipped = table(spark, sf, "lineitem").where("l_returnflag <> 'A'").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.where(~F.col("o_orderstatus").eqNullSafe(F.when(F.col("s").isNotNull(), "O"))).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[1-3][0-9]$') AND p_name ILIKE '%a%' AND p_type NOT LIKE 'x\\_%' ESCAPE '\\'")
def q27_pattern_filters(spark, sf):
    return table(spark, sf, "part").where(F.col("p_brand").rlike("#[1-3][0-9]$") & F.col("p_name").ilike("%a%") & ~F.col("p_type").like("x\\_%")).select("p_partkey")


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_totalprice), 0) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def q29_outer_join_counts(spark, sf):
    """Every customer, with nothing where no order fits; orders are summed before the join."""
    sums = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("spent"))
    rows = table(spark, sf, "customer").select("c_custkey").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("spent", F.lit(0.0)).alias("spent"))


@query("SELECT user_id, last_buy, row_number() OVER (ORDER BY last_buy DESC NULLS LAST, user_id) AS place FROM (SELECT user_id, max(ts) FILTER (event_type = 'purchase' AND value > 480) AS last_buy FROM events GROUP BY 1)")
def q32_nulls_last(spark, sf):
    """Newest first, keys without a time at the end."""
    last = F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 480), F.col("ts")))
    rows = table(spark, sf, "events").groupBy("user_id").agg(last.alias("last_buy"))
    return ranked(rows, [F.col("last_buy").desc_nulls_last(), "user_id"], "place")


@query("SELECT coalesce(sum(o_totalprice), 0) AS total, count(*) AS n FROM orders WHERE o_orderstatus = 'none'")
def q33_scalar_with_default(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'none'").agg(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("total"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, year(l_shipdate) AS year, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def q34_four_key_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", F.year("l_shipdate").cast("long").alias("year"), "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'error' AND value > 100 THEN 'stale' ELSE event_type END AS event_type FROM events WHERE NOT (event_type = 'view' AND ts < (SELECT max(ts) FROM events) - INTERVAL 20 DAY)")
def q40_bulk_update_and_delete(spark, sf):
    """Rows rewritten by a predicate, and old rows of one kind left out."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value", "ts")
    newest = F.broadcast(e.agg(F.max("ts").alias("newest")))
    kept = e.crossJoin(newest).where("not (event_type = 'view' and ts < newest - interval 20 days)")
    return kept.select("event_id", F.when((F.col("event_type") == "error") & (F.col("value") > 100), "stale").otherwise(F.col("event_type")).alias("event_type"))


@query("""SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS INTEGER) || ',"type":"' || event_type || '"}' AS merged FROM events""")
def q42_json_merge(spark, sf):
    """A stored object with a key set."""
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(k, F.col("event_type").alias("type"))).alias("merged"))


@query("SELECT o_custkey, max(k) + 1 AS next_version FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) GROUP BY 1")
def q45_next_version(spark, sf):
    """One more than the number of versions, without numbering them."""
    return table(spark, sf, "orders").groupBy("o_custkey").agg((F.count("*") + 1).alias("next_version"))


_BETS = """SELECT l_orderkey, l_quantity AS stake, 1 + l_extendedprice / 50000 AS odds, l_discount - 0.04 AS edge, CASE l_returnflag WHEN 'A' THEN 'WON' WHEN 'R' THEN 'LOST' ELSE 'VOID' END AS status FROM lineitem"""


def _bets(spark, sf):
    status = F.when(F.col("l_returnflag") == "A", "WON").when(F.col("l_returnflag") == "R", "LOST").otherwise("VOID")
    bet = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("stake"), (1 + F.col("l_extendedprice") / 50000).alias("odds"), (F.col("l_discount") - 0.04).alias("edge"), status.alias("status"))
    pnl = F.when(F.col("status") == "WON", F.col("stake") * (F.col("odds") - 1)).when(F.col("status") == "LOST", -F.col("stake")).otherwise(0.0)
    return bet.withColumn("pnl", pnl)


_PNL = f"SELECT *, CASE status WHEN 'WON' THEN stake * (odds - 1) WHEN 'LOST' THEN -stake ELSE 0 END AS pnl FROM ({_BETS})"


@query(f"""
SELECT CASE WHEN odds < 1.5 THEN '<1.5' WHEN odds < 2 THEN '1.5-2' ELSE '2+' END AS bucket, count(*) AS n, count(*) FILTER (status = 'WON') / CAST(count(*) FILTER (status <> 'VOID') AS DOUBLE) AS win_rate,
  sum(stake) AS turnover, sum(pnl) AS net, sum(pnl) / sum(stake) AS roi, avg(odds) AS avg_odds, avg(edge) AS avg_edge FROM ({_PNL}) GROUP BY 1
""")
def ag9_bucket_statistics(spark, sf):
    """Results by price range; voids count in turnover and mean price, not in the win rate."""
    bucket = F.when(F.col("odds") < 1.5, "<1.5").when(F.col("odds") < 2, "1.5-2").otherwise("2+")
    won, decided = F.count_if(F.col("status") == "WON"), F.count_if(F.col("status") != "VOID")
    return _bets(spark, sf).groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("n"), (won / decided).alias("win_rate"), F.sum("stake").alias("turnover"), F.sum("pnl").alias("net"),
        (F.sum("pnl") / F.sum("stake")).alias("roi"), F.avg("odds").alias("avg_odds"), F.avg("edge").alias("avg_edge"),
    )


@query(f"""
WITH s AS (SELECT 'odds' AS dimension, CASE WHEN odds < 2 THEN 'short' ELSE 'long' END AS segment, pnl, status FROM ({_PNL}) UNION ALL
  SELECT 'edge', CASE WHEN edge < 0 THEN 'none' WHEN edge < 0.03 THEN 'thin' ELSE 'wide' END, pnl, status FROM ({_PNL}))
SELECT dimension, segment, count(*) AS n, sum(pnl) AS pnl, count(*) FILTER (pnl > 0) AS wins FROM s GROUP BY 1, 2
""")
def ag16_segments(spark, sf):
    """Results by two ways of grouping, from one scan."""
    odds = F.struct(F.lit("odds").alias("dimension"), F.when(F.col("odds") < 2, "short").otherwise("long").alias("segment"))
    edge = F.struct(F.lit("edge").alias("dimension"), F.when(F.col("edge") < 0, "none").when(F.col("edge") < 0.03, "thin").otherwise("wide").alias("segment"))
    rows = _bets(spark, sf).select("pnl", F.explode(F.array(odds, edge)).alias("s")).groupBy("s.dimension", "s.segment")
    return rows.agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"), F.count_if(F.col("pnl") > 0).alias("wins"))


@query(f"SELECT l_orderkey, avg(-CASE status WHEN 'WON' THEN ln(1 / odds) ELSE ln(1 - 1 / (odds + 0.01)) END) AS loss FROM ({_PNL}) WHERE status <> 'VOID' GROUP BY 1")
def ag11_mean_loss_per_match(spark, sf):
    """The mean log loss of each match, so that long ones weigh no more than short ones."""
    loss = -F.when(F.col("status") == "WON", F.ln(1 / F.col("odds"))).otherwise(F.ln(1 - 1 / (F.col("odds") + 0.01)))
    return _bets(spark, sf).where("status <> 'VOID'").groupBy("l_orderkey").agg(F.avg(loss).alias("loss"))


@query(f"""
WITH w AS (SELECT l_orderkey, status = 'WON' AS y, least(greatest(1 / odds, 1e-6), 1 - 1e-6) AS p, 1 / CAST(count(*) OVER (PARTITION BY l_orderkey) AS DOUBLE) AS base FROM ({_PNL}))
SELECT l_orderkey, sum(base) AS base, sum(base * power(1 - CASE WHEN y THEN p ELSE 1 - p END, 2)) AS focal FROM w GROUP BY 1
""")
def ag27_focal_weights(spark, sf):
    """Weights of rows by match, raised where the first fit was wrong (gamma 2)."""
    p = F.least(F.greatest(1 / F.col("odds"), F.lit(1e-6)), F.lit(1 - 1e-6))
    miss = F.pow(1 - F.when(F.col("status") == "WON", p).otherwise(1 - p), F.lit(2.0))
    return _bets(spark, sf).groupBy("l_orderkey").agg((F.count("*") / F.count("*")).alias("base"), F.avg(miss).alias("focal"))


@query("SELECT o_custkey, min_by(o_totalprice, (CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey)) AS price FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def ag33_preferred_source(spark, sf):
    """The price of the most trusted source that has a valid one."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, sf, "orders").where("o_totalprice > 1000").groupBy("o_custkey").agg(F.min_by("o_totalprice", F.struct(rank, F.col("o_orderkey"))).alias("price"))


@query("""
WITH m AS (SELECT event_type, date_trunc('day', ts) AS day, avg(power(least(value / 500, 1) - CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) > 50 THEN 1 ELSE 0 END, 2)) AS brier FROM events GROUP BY 1, 2),
p AS (SELECT *, lag(brier) OVER (PARTITION BY event_type ORDER BY day) AS before FROM m)
SELECT event_type, day, brier, before, CASE WHEN before IS NULL THEN 'first' WHEN brier > before + 0.02 THEN 'worse' ELSE 'ok' END AS verdict FROM p
""")
def ag44_guard_against_previous(spark, sf):
    """Each version's Brier score against the one before it."""
    y = F.when(F.get_json_object("props", "$.k").cast("int") > 50, 1).otherwise(0)
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day")
    rows = table(spark, sf, "events").groupBy("event_type", day).agg(F.avg(F.pow(F.least(F.col("value") / 500, F.lit(1.0)) - y, F.lit(2.0))).alias("brier"))
    rows = rows.withColumn("before", F.lag("brier").over(Window.partitionBy("event_type").orderBy("day")))
    verdict = F.when(F.col("before").isNull(), "first").when(F.col("brier") > F.col("before") + 0.02, "worse").otherwise("ok")
    return rows.withColumn("verdict", verdict)


@query("""
SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN lang IS NULL THEN 'no_lang' END, CASE WHEN source IS NULL THEN 'no_source' END, CASE WHEN text IS NULL THEN 'no_text' END,
  CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END]) AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY 1
""")
def ag31_rejection_counts(spark, sf):
    """How often each reason to reject a row holds."""
    why = [F.when(F.col(c).isNull(), F.lit(f"no_{c}")) for c in ("lang", "source", "text")]
    why += [F.when(F.col("n_chars") < 200, F.lit("short")), F.when(F.col("n_chars") > 5000, F.lit("long"))]
    rows = table(spark, sf, "documents").select(F.explode(F.array_compact(F.array(*why))).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))
