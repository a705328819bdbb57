"""Row-wise pricing, staking, scoring and state rules.

``events.value`` gives a price (1 + value / 100) and ``props.k`` a probability in percent; ``lineitem``
stands for bets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prices as P
from ..sources.tables import table
from .registry import query

_E = "SELECT event_id, event_type, 1 + value / 100 AS odds, CAST(json_extract(props, '$.k') AS INTEGER) / 100.0::DOUBLE AS p FROM events"


def _offers(spark: SparkSession, sf: str) -> DataFrame:
    p = F.get_json_object("props", "$.k").cast("int") / F.lit(100.0)
    return table(spark, sf, "events").select("event_id", "event_type", (1 + F.col("value") / 100).alias("odds"), p.alias("p"))


@query(f"SELECT event_id, (1 / odds) / (1 / odds + 0.5) AS share FROM ({_E})")
def sc2_share_of_side(spark, sf):
    """The unrounded fair share of one side against a price of 2."""
    a = 1 / F.col("odds")
    return _offers(spark, sf).select("event_id", (a / (a + 0.5)).alias("share"))


@query(f"""
WITH q AS (SELECT event_id, least(greatest(1 / odds, 1e-4), 1 - 1e-4) AS a, least(greatest(p, 1e-4), 1 - 1e-4) AS b FROM ({_E}))
SELECT event_id, ln(b / (1 - b)) - ln(a / (1 - a)) AS shift FROM q
""")
def sc3_closing_shift(spark, sf):
    """How far the closing chance lies from the executed one, in clipped log odds."""
    return _offers(spark, sf).select("event_id", (P.clipped_logit(F.col("p")) - P.clipped_logit(1 / F.col("odds"))).alias("shift"))


@query(f"""
WITH e AS (SELECT event_id, p * odds - 1 AS a, (1 - p) * 2.5 - 1 AS b FROM ({_E}))
SELECT event_id, CASE WHEN greatest(a, b) < 0.05 THEN NULL WHEN a >= b THEN 'a' ELSE 'b' END AS side, greatest(a, b) AS best FROM e
""")
def sc5_favoured_side(spark, sf):
    """The side of the larger edge if it reaches the least edge; ties go to a."""
    a, b = P.expected_value(F.col("p"), F.col("odds")), P.expected_value(1 - F.col("p"), F.lit(2.5))
    best = F.greatest(a, b)
    return _offers(spark, sf).select("event_id", F.when(best >= 0.05, F.when(a >= b, "a").otherwise("b")).alias("side"), best.alias("best"))


@query(f"""
WITH e AS (SELECT event_id, p * odds - 1 AS edge, CASE event_type WHEN 'click' THEN 250 WHEN 'view' THEN 10000 * 0.02
  ELSE CASE WHEN odds > 1 THEN 10000 * greatest(0, (p * (odds - 1) - (1 - p)) / (odds - 1)) * 0.25 ELSE 0 END END AS raw FROM ({_E}))
SELECT event_id, CASE WHEN edge <= 0 OR least(raw, 500) < 10 THEN CAST(0 AS DOUBLE) ELSE CAST(least(raw, 500) AS DOUBLE) END AS stake FROM e
""")
def sc10_stake_modes(spark, sf):
    """A fixed stake, a percentage or a Kelly share of the bank; capped, and nothing below the least stake."""
    bank, p, odds = 10000.0, F.col("p"), F.col("odds")
    mode = F.col("event_type")
    raw = F.when(mode == "click", 250.0).when(mode == "view", bank * 0.02).otherwise(P.kelly(p, odds, 0.25) * bank)
    stake = F.least(raw, F.lit(bank * 0.05))
    return _offers(spark, sf).select("event_id", F.when((P.expected_value(p, odds) <= 0) | (stake < 10), 0.0).otherwise(stake).alias("stake"))


@query(f"""
WITH q AS (SELECT event_id, least(greatest(1 / odds, 1e-4), 1 - 1e-4) AS m, least(greatest(p - 0.5, -0.35), 0.35) AS c FROM ({_E}))
SELECT event_id, 1 / (1 + exp(-(ln(m / (1 - m)) + c))) AS p_final FROM q
""")
def sc12_market_offset(spark, sf):
    """A bounded correction of the market's log odds."""
    c = F.least(F.greatest(F.col("p") - 0.5, F.lit(-0.35)), F.lit(0.35))
    return _offers(spark, sf).select("event_id", (1 / (1 + F.exp(-(P.clipped_logit(1 / F.col("odds")) + c)))).alias("p_final"))


@query("SELECT o_orderkey, regexp_replace(o_orderpriority, '[^0-9-]', '', 'g') AS digits FROM orders")
def sc19_digits(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.regexp_replace("o_orderpriority", "[^0-9-]", "").alias("digits"))


@query("""
WITH a AS (SELECT event_id, greatest(0, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) // 1000000 AS age, event_type = 'signup' AS unknown FROM events)
SELECT event_id, CAST(CASE WHEN unknown THEN 0.5 WHEN age <= 21600 THEN 1 WHEN age <= 86400 THEN 0.9 WHEN age <= 259200 THEN 0.75
  WHEN age <= 604800 THEN 0.5 WHEN age <= 1209600 THEN 0.2 ELSE 0 END AS DOUBLE) AS freshness FROM a
""")
def sc31_freshness(spark, sf):
    """Steps by age; a missing time of publication scores one half."""
    published = F.when(F.col("event_type") != "signup", F.unix_micros(F.col("ts").cast("timestamp")))
    now = F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    age = F.floor(F.greatest(F.lit(0), now - published) / 1000000)
    # Hours up to which a page has the score.
    score = F.when(published.isNull(), 0.5)
    for hours, s in ((6, 1.0), (24, 0.9), (72, 0.75), (168, 0.5), (336, 0.2)):
        score = score.when(age <= hours * 3600, s)
    return table(spark, sf, "events").select("event_id", score.otherwise(0.0).alias("freshness"))


@query("""
SELECT user_id, (count(*) FILTER (event_type = 'purchase') + 0.62 * 80) / CAST(count(*) + 80 AS DOUBLE) AS rate FROM events GROUP BY 1
""")
def sc46_smoothed_rate(spark, sf):
    """A share drawn towards a prior that counts as 80 trials."""
    won = F.count_if(F.col("event_type") == "purchase")
    return table(spark, sf, "events").groupBy("user_id").agg(((won + 0.62 * 80) / (F.count("*") + 80)).alias("rate"))


@query("""
WITH s AS (SELECT vec_id, list_max(embedding[1:4])::DOUBLE - list_min(embedding[1:4])::DOUBLE AS spread FROM embeddings)
SELECT vec_id, spread, greatest(0, least(1, (1 - spread) * 0.8)) AS certainty FROM s
""")
def sc47_certainty(spark, sf):
    """Agreement of several forecasts (1 less their spread), scaled by reliability."""
    four = F.slice("embedding", 1, 4)
    rows = table(spark, sf, "embeddings").select("vec_id", (F.array_max(four).cast("double") - F.array_min(four).cast("double")).alias("spread"))
    return rows.withColumn("certainty", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.col("spread")) * 0.8)))


@query("SELECT c_custkey, sha256('{\"nation\":' || c_nationkey || ',\"segment\":\"' || c_mktsegment || '\"}') AS digest FROM customer")
def sc50_canonical_digest(spark, sf):
    """SHA-256 of an object with its keys in order."""
    body = F.to_json(F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")))
    return table(spark, sf, "customer").select("c_custkey", F.sha2(body, 256).alias("digest"))


@query("""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host,
  regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)='))) AS kept FROM u)
SELECT page_id, scheme || '://' || host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM k
""")
def sc27_canonical_url(spark, sf):
    """Lower-cased host, no fragment, no tracking parameters, the rest of the query in order."""
    url = F.col("url")
    kept = F.sort_array(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: (x != "") & ~x.rlike("^(utm_[^=]*|ref|fbclid|gclid)=")))
    head = F.concat(F.regexp_extract(url, "^(https?)://", 1), F.lit("://"), F.lower(F.regexp_extract(url, "^https?://([^/?#]+)", 1)), F.regexp_extract(url, "^https?://[^/?#]+([^?#]*)", 1))
    return table(spark, sf, "pages").select("page_id", F.concat(head, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")).alias("canonical"))


@query("SELECT event_id, CASE WHEN p >= 0.5 THEN odds >= 1.5 AND odds < 3 ELSE odds >= 3 AND odds < 5 END AS allowed FROM (" + _E + ")")
def fil8_range_gate(spark, sf):
    """Price ranges by the side of the forecast: the lower end is inside, the upper is not."""
    odds = F.col("odds")
    return _offers(spark, sf).select("event_id", F.when(F.col("p") >= 0.5, (odds >= 1.5) & (odds < 3)).otherwise((odds >= 3) & (odds < 5)).alias("allowed"))


@query("SELECT event_id FROM (" + _E + ") WHERE p * odds - 1 >= 0.03 AND p >= 0.4 AND odds BETWEEN 1.5 AND 4")
def fil9_policy_accepts(spark, sf):
    """All gates at once; both ends of the price band are inside."""
    return _offers(spark, sf).where((P.expected_value(F.col("p"), F.col("odds")) >= 0.03) & (F.col("p") >= 0.4) & F.col("odds").between(1.5, 4)).select("event_id")


@query("""
SELECT event_type, CASE WHEN upper(trim(event_type)) IN ('SIGNUP', 'SCHEDULED') THEN 'SCHEDULED' WHEN upper(trim(event_type)) IN ('ERROR', 'PAUSED') THEN 'SUSPENDED'
  WHEN upper(trim(event_type)) IN ('PURCHASE', 'FINISHED') THEN 'FINISHED' ELSE 'LIVE' END AS state, count(*) AS n FROM events GROUP BY ALL
""")
def fil19_canonical_state(spark, sf):
    """Aliases of a state, whatever their case; an unknown one is live."""
    raw = F.upper(F.trim("event_type"))
    state = F.when(raw.isin("SIGNUP", "SCHEDULED"), "SCHEDULED").when(raw.isin("ERROR", "PAUSED"), "SUSPENDED").when(raw.isin("PURCHASE", "FINISHED"), "FINISHED")
    return table(spark, sf, "events").groupBy("event_type", state.otherwise("LIVE").alias("state")).agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity > 45 THEN 'size' END, CASE WHEN l_discount = 0 THEN 'no_margin' END,
  CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN 'late' END], lambda x: x IS NOT NULL), ',') AS reasons FROM lineitem
""")
def fil26_row_reasons(spark, sf):
    """Every reason to reject a row, in order."""
    late = F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    why = P.all_reasons(("size", F.col("l_quantity") > 45), ("no_margin", F.col("l_discount") == 0), ("returned", F.col("l_returnflag") == "R"), ("late", late))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(why, ",").alias("reasons"))


@query("""
SELECT user_id, bool_or(event_type = 'purchase') AND max(ts) >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AS fresh FROM events WHERE ts <= TIMESTAMP '2024-01-31' GROUP BY 1
""")
def fil29_coverage_is_fresh(spark, sf):
    """Complete, and checked not too long before the time asked about."""
    rows = table(spark, sf, "events").where("ts <= timestamp_ntz '2024-01-31'").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("complete"), F.max("ts").alias("checked"))
    return rows.select("user_id", F.expr("complete and checked >= timestamp_ntz '2024-01-31' - interval 7 days").alias("fresh"))
