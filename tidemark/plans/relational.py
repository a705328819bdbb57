"""Relational shapes of the read surface: anti, semi and grouped lookups, upserts, JSON, ordering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.asof import latest_per_key
from ..sources.tables import table
from .registry import query


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def q1_latest_per_key(spark, sf):
    return latest_per_key(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def q8_top_n_per_group(spark, sf):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", n.alias("n")).where("n <= 3").drop("n")


@query("SELECT user_id, bool_or(k > 95) AS flagged FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1")
def q14_boolean_aggregate(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.bool_or(F.get_json_object("props", "$.k").cast("int") > 95).alias("flagged"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '2000-06-01')")
def q15_anti_join(spark, sf):
    late = table(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz '2000-06-01'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(late, "p_partkey", "left_anti").select("p_partkey")


@query("SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def q17_semi_join(spark, sf):
    rich = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf, "nation").join(rich, "n_nationkey", "left_semi").select("n_name")


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def q19_distinct_having(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("flags")).where("flags > 1")


@query("""
SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'keep' WHEN n.v IS DISTINCT FROM o.v THEN 'update' ELSE 'same' END AS change
FROM (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1) o
FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' GROUP BY 1) n ON n.k = o.k
""")
def q23_upsert(spark, sf):
    """An upsert as a rewrite: new values win, and unchanged rows are told apart null-safely."""
    best = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"))
    value = lambda cond: F.max(F.when(F.expr(cond), F.col("o_totalprice")))
    both = best.agg(value("o_orderdate < timestamp_ntz '1998-01-01'").alias("o"), value("o_orderdate >= timestamp_ntz '1997-06-01'").alias("n")).where("o is not null or n is not null")
    change = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "keep").when(~F.col("n").eqNullSafe(F.col("o")), "update").otherwise("same")
    return both.select("k", F.coalesce("n", "o").alias("v"), change.alias("change"))


@query("""
SELECT r_name, c_mktsegment, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
""")
def q30_star_join(spark, sf):
    """Orders are summed by customer before the dimensions are joined."""
    spend = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    rows = spend.join(table(spark, sf, "customer"), "c_custkey").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "c_mktsegment").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("SELECT user_id, md5(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS digest FROM events GROUP BY 1")
def q37_set_fingerprint(spark, sf):
    ids = F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.md5(F.array_join(ids, ",")).alias("digest"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract(props, '$.z') IS NOT NULL AS has_z FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def q43_json_keys(spark, sf):
    e = table(spark, sf, "events")
    return e.where(F.get_json_object("props", "$.k").isNotNull()).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.z").isNotNull().alias("has_z"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY GROUP BY 1")
def q44_trailing_interval(spark, sf):
    return table(spark, sf, "events").where("ts >= timestamp_ntz '2024-01-30' - interval 7 days").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
SELECT slug, n FROM (SELECT c_mktsegment AS slug, count(*) AS n FROM customer GROUP BY 1) ORDER BY CASE slug WHEN 'BUILDING' THEN 0 ELSE 1 END, n DESC, slug LIMIT 3
""")
def q31_case_order(spark, sf):
    n = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("slug")).agg(F.count("*").alias("n"))
    return n.orderBy(F.when(F.col("slug") == "BUILDING", 0).otherwise(1), F.desc("n"), "slug").limit(3)


@query("""
SELECT min_edge, min_odds, count(*) AS bets, avg(l_discount) AS mean FROM lineitem, (SELECT unnest([0.02, 0.05]) AS min_edge), (SELECT unnest([10, 30, 45]) AS min_odds)
WHERE l_discount >= min_edge AND l_quantity >= min_odds GROUP BY 1, 2 HAVING count(*) >= 30
""")
def t5_grid_search(spark, sf):
    """Every cell of a small grid in one pass: each row lists the cells it is in, and partial sums meet."""
    cells = [F.when((F.col("l_discount") >= e) & (F.col("l_quantity") >= o), F.struct(F.lit(e).alias("min_edge"), F.lit(o).alias("min_odds"))) for e in (0.02, 0.05) for o in (10, 30, 45)]
    rows = table(spark, sf, "lineitem").select("l_discount", F.explode(F.array_compact(F.array(*cells))).alias("c"))
    return rows.groupBy("c.min_edge", "c.min_odds").agg(F.count("*").alias("bets"), F.avg("l_discount").alias("mean")).where("bets >= 30")
