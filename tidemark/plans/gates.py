"""Filters, reject chains and price expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prices as P
from ..operators.asof import asof_backward
from ..operators.series import previous
from ..sources.tables import table
from .registry import query


@query("SELECT event_id, user_id, ts FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'")
def fil1_point_in_time(spark, sf):
    """Rows that were visible at the cutoff, the cutoff included; the filter reaches the scan."""
    return table(spark, sf, "events").where("ts <= timestamp_ntz '2024-01-15 12:00:00'").select("event_id", "user_id", "ts")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN o < 1.2 THEN 'ODDS_TOO_SHORT' WHEN o >= 6 THEN 'ODDS_TOO_LONG' WHEN l_discount < 0.05 THEN 'PROBABILITY_TOO_LOW' ELSE '' END AS reason
FROM (SELECT *, 1 + l_quantity / 9 AS o FROM lineitem)
""")
def fil6_price_policy(spark, sf):
    """Lower bounds are inside, upper bounds outside; the first failing check names the reason."""
    o = 1 + F.col("l_quantity") / 9
    reason = P.first_reason(("ODDS_TOO_SHORT", o < 1.2), ("ODDS_TOO_LONG", o >= 6), ("PROBABILITY_TOO_LOW", F.col("l_discount") < 0.05))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"))


@query("""
SELECT l.event_id, CASE WHEN q.ts IS NULL THEN 'NO_ODDS_SNAPSHOT' WHEN CAST(json_extract(q.props, '$.k') AS INTEGER) >= 90 THEN 'MARKET_SUSPENDED'
  WHEN l.ts - q.ts > INTERVAL 24 HOUR THEN 'STALE_ODDS' WHEN q.value <= 1 THEN 'INVALID_ODDS' WHEN q.value < l.value * 0.5 THEN 'PRICE_SLIPPED' ELSE '' END AS reason
FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') q ON l.user_id = q.user_id AND l.ts >= q.ts
""")
def fil10_execution_chain(spark, sf):
    """Why a decision could not be filled at the quote that stood then: the first reason in order."""
    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", F.col("value").alias("asked"))
    right = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("odds"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_id").alias("rid"))
    rows = asof_backward(left, right, "user_id", "ts", "at", ["odds", "k"], tie="rid")
    reason = P.first_reason(
        ("NO_ODDS_SNAPSHOT", F.col("matched_at").isNull()), ("MARKET_SUSPENDED", F.col("k") >= 90), ("STALE_ODDS", F.expr("ts - interval 24 hours > matched_at")),
        ("INVALID_ODDS", F.col("odds") <= 1), ("PRICE_SLIPPED", F.col("odds") < F.col("asked") * 0.5),
    )
    return rows.select("event_id", reason.alias("reason"))


@query("""
WITH a AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
ok(p, n) AS (VALUES ('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('purchase', 'view'), ('view', 'error'), ('click', 'error'))
SELECT event_id, p || '>' || event_type AS step FROM a WHERE p IS NOT NULL AND p <> event_type AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.p = a.p AND ok.n = a.event_type)
""")
def fil18_illegal_transitions(spark, sf):
    """State changes that are not in the table of legal ones; staying is legal."""
    legal = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("purchase", "view"), ("view", "error"), ("click", "error")]
    step = F.concat_ws(">", "_p.event_type", "event_type")
    rows = previous(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "event_type", step.alias("step"))
    fine = [f"{a}>{b}" for a, b in legal]
    return rows.where(F.col("step").contains(">") & ~F.col("step").isin(fine) & (F.substring_index("step", ">", 1) != F.col("event_type"))).select("event_id", "step")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN a > 1 AND b > 1 THEN round((1 / a) / (1 / a + 1 / b), 4) ELSE 0.5 END AS fair_a, CASE WHEN a > 1 AND b > 1 THEN round(1 / a + 1 / b - 1, 4) ELSE 0 END AS margin
FROM (SELECT *, l_quantity / 10 AS a, 1 + l_tax * 50 AS b FROM lineitem)
""")
def sc1_no_vig(spark, sf):
    fair_a, _, margin = P.no_vig(F.col("l_quantity") / 10, 1 + F.col("l_tax") * 50)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fair_a.alias("fair_a"), margin.alias("margin"))


@query("""
SELECT l_orderkey, l_linenumber, p - 1 / o AS edge, p * o - 1 AS ev, CASE WHEN o > 1 THEN greatest(0, (p * o - 1) / (o - 1)) * 0.25 ELSE 0 END AS stake, ln(q / (1 - q)) AS logit
FROM (SELECT *, least(greatest(p, 1e-4), 1 - 1e-4) AS q FROM (SELECT *, l_discount * 10 AS p, 1 + l_quantity / 20 AS o FROM lineitem))
""")
def sc6_edges_and_kelly(spark, sf):
    p, o = F.col("l_discount") * 10, 1 + F.col("l_quantity") / 20
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", P.edge(p, o).alias("edge"), P.expected_value(p, o).alias("ev"), P.kelly(p, o, 0.25).alias("stake"), P.clipped_logit(p).alias("logit"))


@query("""
SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS host, starts_with(url, 'https:') AS secure FROM pages
""")
def sc33_hosts(spark, sf):
    host = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1), r"^www\.", "")
    return table(spark, sf, "pages").select("page_id", host.alias("host"), F.col("url").startswith("https:").alias("secure"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)', 1), ''), nullif(regexp_extract(html, '<h1>([^<]*)', 1), ''), 'untitled') AS title FROM pages")
def sc29_titles(spark, sf):
    first = lambda tag: F.nullif(F.regexp_extract("html", f"<{tag}>([^<]*)", 1), F.lit(""))
    return table(spark, sf, "pages").select("page_id", F.coalesce(first("title"), first("h1"), F.lit("untitled")).alias("title"))
