"""Top-k, paging, shortlists, splits and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prices as P
from ..operators.asof import latest_per_key
from ..operators.ranking import ranked
from ..sources.tables import table
from .registry import query


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def t2_bounded_top_k(spark, sf):
    """The k largest; of equal ones the older stays."""
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def t7_page(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) AS n FROM customer) WHERE n = 1")
def ag25_strongest_per_key(spark, sf):
    """One row of each key, the strongest, combined before the shuffle."""
    return latest_per_key(table(spark, sf, "customer").select("c_nationkey", "c_acctbal", "c_custkey"), ["c_nationkey"], ["c_acctbal", "c_custkey"]).select("c_nationkey", "c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_discount * 10 - 1 / (1 + l_quantity / 20) AS edge FROM lineitem WHERE l_discount * 10 - 1 / (1 + l_quantity / 20) >= 0.4 AND l_quantity >= 20")
def fil13_shortlist(spark, sf):
    edge = P.edge(F.col("l_discount") * 10, 1 + F.col("l_quantity") / 20)
    return table(spark, sf, "lineitem").where("l_quantity >= 20").select("l_orderkey", "l_linenumber", edge.alias("edge")).where("edge >= 0.4")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND value > 1 AND value <= 100 AND 1 / value + 1 / 3.0 BETWEEN 0.35 AND 0.6")
def fil3_sane_quotes(spark, sf):
    """Prices in range whose margin is in the band, both ends inside."""
    ok = F.col("event_type").isin("click", "view") & (F.col("value") > 1) & (F.col("value") <= 100) & (1 / F.col("value") + 1 / F.lit(3.0)).between(0.35, 0.6)
    return table(spark, sf, "events").where(ok).select("event_id")


@query("""
SELECT o_custkey, CASE WHEN k <= floor(0.6 * n) THEN 'train' WHEN k <= floor(0.8 * n) THEN 'valid' ELSE 'test' END AS part FROM (
  SELECT o_custkey, row_number() OVER (ORDER BY first, o_custkey) AS k, count(*) OVER () AS n FROM (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1))
""")
def w43_chronological_split(spark, sf):
    """60/20/20 by first appearance of whole entities."""
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    rows = ranked(first, ["first", "o_custkey"], total="n")
    part = F.when(F.col("k") <= F.floor(F.col("n") * 0.6), "train").when(F.col("k") <= F.floor(F.col("n") * 0.8), "valid").otherwise("test")
    return rows.select("o_custkey", part.alias("part"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS invalid, count(*) AS n, count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE) AS rate FROM events GROUP BY 1")
def ag7_conditional_rates(spark, sf):
    bad = F.count_if(F.col("event_type") == "error")
    return table(spark, sf, "events").groupBy("user_id").agg(bad.alias("invalid"), F.count("*").alias("n"), (bad / F.count("*")).alias("rate"))
