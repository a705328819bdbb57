"""Web pages and their addresses, source availability, and as-of links between sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.asof import asof_backward, latest_per_key
from ..sources.tables import table
from .registry import query

# Internal hosts, and suffixes that are always and never read.
INTERNAL = r"^(localhost|127\.|10\.|192\.168\.|169\.254\.)"
DENIED, ALLOWED = ("m.example.net", "ads.example.com"), ("example.org", "example.net")


def _suffix_sql(host: str, names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{host} = '{n}' OR ends_with({host}, '.{n}')" for n in names) + ")"


@query(f"""
WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN regexp_matches(host, '{INTERNAL}') THEN 'internal' WHEN {_suffix_sql("host", DENIED)} THEN 'denied'
  WHEN {_suffix_sql("host", ALLOWED)} THEN 'allowed' ELSE 'unlisted' END AS verdict FROM u
""")
def fil15_domain_policy(spark, sf):
    """Scheme, then internal hosts, then names never read, then names always read; a name holds for its subdomains."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1))

    def under(names):
        out = F.lit(False)
        for n in names:
            out = out | (host == n) | host.endswith("." + n)
        return out

    verdict = F.when(~F.regexp_extract("url", "^([a-z]+)://", 1).isin("http", "https"), "scheme").when(host.rlike(INTERNAL), "internal").when(under(DENIED), "denied").when(under(ALLOWED), "allowed")
    return table(spark, sf, "pages").select("page_id", verdict.otherwise("unlisted").alias("verdict"))


_STRIP = [
    (r"(?is)<!--.*?-->", " "), (r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "),
    (r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])[^>]*>", "\n"), (r"(?s)<[^>]*>", " "),
    (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#39;", "'"), (r"&amp;", "&"),
    (r"[ \t\r\f]+", " "), (r" *\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", ""),
]


def _strip_sql() -> str:
    out = "html"
    for pattern, to in _STRIP:
        new = "chr(10)" if to == "\n" else "'" + to.replace("'", "''") + "'"
        out = f"regexp_replace({out}, '{pattern}', {new}, 'g')"
    return out


def plain_text(html):
    """A page's text: scripts, styles and comments dropped, block ends as line ends, space squeezed."""
    for pattern, to in _STRIP:
        html = F.regexp_replace(html, pattern, to)
    return html


@query(f"SELECT page_id, {_strip_sql()} AS text FROM pages")
def sc28_strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", plain_text(F.col("html")).alias("text"))


@query(f"WITH t AS (SELECT page_id, {_strip_sql()} AS text FROM pages) SELECT page_id, sha256(text) AS digest, left(text, 400) AS snippet, length(text) AS n_chars FROM t")
def sc32_page_digest(spark, sf):
    """Content hash, the first 400 characters for display, and the length."""
    text = table(spark, sf, "pages").select("page_id", plain_text(F.col("html")).alias("text"))
    return text.select("page_id", F.sha2("text", 256).alias("digest"), F.substring("text", 1, 400).alias("snippet"), F.length("text").cast("long").alias("n_chars"))


@query("""
SELECT url, min(page_id) AS first, CASE WHEN regexp_matches(url, '/(es|fr)/') THEN 0 ELSE 1 END AS hub,
  CASE WHEN contains(url, '.example.org') THEN 0 WHEN contains(url, '.example.net') THEN 1 ELSE 2 END AS place FROM pages GROUP BY ALL
""")
def t3_prioritised_urls(spark, sf):
    """Distinct addresses with the keys by which they are fetched: hubs, then the host's place, then the first seen."""
    url = F.col("url")
    hub = F.when(url.rlike("/(es|fr)/"), 0).otherwise(1)
    place = F.when(url.contains(".example.org"), 0).when(url.contains(".example.net"), 1).otherwise(2)
    return table(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("first")).select("url", "first", hub.alias("hub"), place.alias("place"))


@query("""
WITH f AS (SELECT page_id, contains(lower(html), 'nation') AS a, contains(lower(html), 'tion') AS b, regexp_matches(url, '/en/') AS c, contains(url, 'blog') AS d, contains(lower(html), 'cookie') AS x FROM pages)
SELECT page_id, greatest(0, least(1, CASE WHEN a THEN 0.38::DOUBLE ELSE 0 END + CASE WHEN b THEN 0.38::DOUBLE ELSE 0 END + CASE WHEN c THEN 0.14::DOUBLE ELSE 0 END
  + CASE WHEN d THEN 0.12::DOUBLE ELSE 0 END - CASE WHEN x THEN 0.45::DOUBLE ELSE 0 END)) AS relevance FROM f
""")
def sc35_relevance(spark, sf):
    """Additive score of both names, subject and source, less noise, between 0 and 1."""
    body, url = F.lower("html"), F.col("url")
    flags = ((body.contains("nation"), 0.38), (body.contains("tion"), 0.38), (url.rlike("/en/"), 0.14), (url.contains("blog"), 0.12), (body.contains("cookie"), -0.45))
    score = F.lit(0.0)
    for flag, points in flags:
        score = score + F.when(flag, points).otherwise(0.0)
    return table(spark, sf, "pages").select("page_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("relevance"))


@query("SELECT page_id FROM pages WHERE regexp_matches(lower(url), '(utm_|/tag/|ref=)') AND NOT regexp_matches(url, '/es/')")
def sc61_noise(spark, sf):
    """Addresses that match a pattern of noise, hubs excepted."""
    return table(spark, sf, "pages").where(F.lower("url").rlike("(utm_|/tag/|ref=)") & ~F.col("url").rlike("/es/")).select("page_id")


@query("""
WITH g AS (SELECT user_id, max(ts) FILTER (event_type = 'click') AS click, max(ts) FILTER (event_type = 'purchase') AS purchase, max(ts) FILTER (event_type = 'signup') AS signup FROM events GROUP BY 1)
SELECT user_id, concat_ws(',', CASE WHEN click IS NULL THEN 'click' END, CASE WHEN purchase IS NULL THEN 'purchase' END, CASE WHEN signup IS NULL THEN 'signup' END) AS missing,
  concat_ws(',', CASE WHEN click > TIMESTAMP '2024-01-28' THEN 'click' END, CASE WHEN purchase > TIMESTAMP '2024-01-28' THEN 'purchase' END, CASE WHEN signup > TIMESTAMP '2024-01-28' THEN 'signup' END) AS future FROM g
""")
def sc51_source_availability(spark, sf):
    """Groups of sources that a key lacks, and those that are newer than the time asked about."""
    kinds = ("click", "purchase", "signup")
    rows = table(spark, sf, "events").groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == k, F.col("ts"))).alias(k) for k in kinds])
    late = F.lit("2024-01-28").cast("timestamp_ntz")
    missing = F.concat_ws(",", *[F.when(F.col(k).isNull(), k) for k in kinds])
    future = F.concat_ws(",", *[F.when(F.col(k) > late, k) for k in kinds])
    return rows.select("user_id", missing.alias("missing"), future.alias("future"))


@query(r"""SELECT event_id, regexp_extract('note: ' || props || ' end', '\{[^{}]*\}', 0) AS body FROM events""")
def sc53_first_object(spark, sf):
    """The first object in a text around it."""
    return table(spark, sf, "events").select("event_id", F.regexp_extract(F.concat(F.lit("note: "), "props", F.lit(" end")), r"\{[^{}]*\}", 0).alias("body"))


@query("""
SELECT event_id, 0.4 * least(1, value / 400) + 0.3 * least(1, greatest(0, (k - 20) / 60.0)) + 0.2 * CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END + 0.1 * greatest(0, 1 - value / 200) AS score
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
""")
def t1_weighted_composite(spark, sf):
    """Four parts between 0 and 1 under fixed weights."""
    one, zero = F.lit(1.0), F.lit(0.0)
    k, value = F.get_json_object("props", "$.k").cast("int"), F.col("value")
    parts = ((0.4, F.least(one, value / 400)), (0.3, F.least(one, F.greatest(zero, (k - 20) / 60))), (0.2, F.when(F.col("event_type") == "purchase", one).otherwise(zero)), (0.1, F.greatest(zero, 1 - value / 200)))
    score = zero
    for weight, part in parts:
        score = score + weight * part
    return table(spark, sf, "events").select("event_id", score.alias("score"))


@query("""
SELECT user_id, min_by(event_type, (worst, -total)) AS mode FROM (SELECT user_id, event_type, max(value) AS worst, count(*) AS total FROM events GROUP BY 1, 2) GROUP BY 1
""")
def t6_preferred_mode(spark, sf):
    """The mode of least drawdown; of equal ones that of the larger bank, and of these the one seen first.

    A mode without any drawdown comes after all others, and one without a name is taken only where no other is.
    """
    modes = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("worst"), F.count("*").alias("total"), F.min("event_id").alias("first"))
    rank = F.struct(F.col("worst").isNull(), F.col("worst"), -F.col("total"), F.col("first"), F.col("event_type"))
    return modes.groupBy("user_id").agg(F.min_by("event_type", F.when(F.col("event_type").isNotNull(), rank)).alias("mode"))


@query("""
SELECT l.event_id, coalesce(r.value, CASE WHEN l.value > 250 THEN 1600 ELSE 1500 END)::DOUBLE AS rating FROM (SELECT * FROM events WHERE event_type = 'view') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') r ON l.user_id = r.user_id AND l.ts >= r.ts
""")
def j9_rating_lookup(spark, sf):
    """The rating as of a time, else a prior by level."""
    e = table(spark, sf, "events")
    left = e.where("event_type = 'view'").select("event_id", "user_id", "ts", "value")
    right = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("rating"), F.col("event_id").alias("rid"))
    out = asof_backward(left, right, "user_id", "ts", "at", ["rating"], tie="rid")
    return out.select("event_id", F.coalesce("rating", F.when(F.col("value") > 250, 1600.0).otherwise(1500.0)).alias("rating"))


@query("""
WITH q AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-01-28')
SELECT user_id, event_type, value FROM q WHERE k = 1 AND ts >= TIMESTAMP '2024-01-28' - INTERVAL 36 HOUR
""")
def j24_fresh_line(spark, sf):
    """The latest quote of each line, if it is young enough; an older one is no quote."""
    rows = table(spark, sf, "events").where("ts <= timestamp_ntz '2024-01-28'").select("user_id", "event_type", "ts", "event_id", "value")
    last = latest_per_key(rows, ["user_id", "event_type"], ["ts", "event_id"])
    return last.where("ts >= timestamp_ntz '2024-01-28' - interval 36 hours").select("user_id", "event_type", "value")


@query("""
WITH l AS (SELECT user_id, event_type, max_by(CAST(json_extract(props, '$.k') AS INTEGER), (ts, event_id)) AS k, max(ts) AS newest FROM events GROUP BY 1, 2)
SELECT user_id, max_by(event_type, (newest, event_type)) AS link FROM l WHERE k >= 30 GROUP BY 1
""")
def j27_newest_confirmed_link(spark, sf):
    """The latest decision of each source first, then the newest that confirms: a revocation hides what it revokes."""
    rows = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    last = latest_per_key(rows, ["user_id", "event_type"], ["ts", "event_id"])
    return last.where("k >= 30").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_type")).alias("link"))


@query("""
WITH n AS (SELECT c_mktsegment, c_nationkey, min(c_custkey) AS fresh FROM customer GROUP BY 1, 2), o AS (SELECT s_nationkey, min(s_suppkey) AS old FROM supplier GROUP BY 1)
SELECT c_mktsegment, c_nationkey, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN old END, fresh) AS id FROM n LEFT JOIN o ON s_nationkey = c_nationkey
""")
def j36_reused_ids(spark, sf):
    """Rebuilt rows keep the ids that stand already."""
    fresh = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.min("c_custkey").alias("fresh"))
    old = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("old"))
    kept = F.coalesce(F.when(F.col("c_mktsegment") == "BUILDING", F.col("old")), F.col("fresh"))
    return fresh.join(old, F.col("c_nationkey") == F.col("s_nationkey"), "left").select("c_mktsegment", "c_nationkey", kept.alias("id"))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS strength, o_orderdate FROM orders)
SELECT o_custkey, max_by(o_orderkey, (strength, o_orderdate, o_orderkey)) AS result FROM s WHERE strength > 0 GROUP BY 1
""")
def ag37_strongest_result(spark, sf):
    """The strongest definitive result of each key; of equal ones the later wins."""
    strength = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", strength.alias("strength"), "o_orderdate").where("strength > 0")
    return rows.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("strength", "o_orderdate", "o_orderkey")).alias("result"))


@query("""
SELECT doc_id, greatest(0, 1 - CASE WHEN lang IS NULL THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN n_chars < 200 THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN source IS NULL THEN 0.5::DOUBLE ELSE 0 END) AS score,
  concat_ws(',', CASE WHEN lang IS NULL THEN 'lang' END, CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN source IS NULL THEN 'source' END) AS reasons FROM documents
""")
def ag42_penalised_quality(spark, sf):
    """One, less a fixed penalty for each flaw, with the flaws' names."""
    flaws = (("lang", F.col("lang").isNull(), 0.3), ("short", F.col("n_chars") < 200, 0.4), ("source", F.col("source").isNull(), 0.5))
    score = F.lit(1.0)
    for _, flaw, points in flaws:
        score = score - F.when(flaw, points).otherwise(0.0)
    return table(spark, sf, "documents").select("doc_id", F.greatest(F.lit(0.0), score).alias("score"), F.concat_ws(",", *[F.when(flaw, name) for name, flaw, _ in flaws]).alias("reasons"))
