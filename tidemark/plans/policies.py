"""Staking, validation, promotion and relevance rules, each a chain of named reasons over one row.

``events.value`` gives a price (1 + value / 100) and ``props.k`` a number from 0 to 99.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import prices as P
from ..operators import metrics as M
from ..sources.tables import table
from .registry import query

_K = "CAST(json_extract(props, '$.k') AS INTEGER)"
_E = f"SELECT *, {_K} AS k, 1 + value / 100 AS odds, {_K} / 100.0::DOUBLE AS p FROM events"


def offers(spark, sf) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select("*", k.alias("k"), (1 + F.col("value") / 100).alias("odds"), (k / F.lit(100.0)).alias("p"))


def chain(*rules: tuple[str, Column]) -> Column:
    """The first rule that holds, else an empty string; a rule on missing data does not hold."""
    out = F.when(F.lit(False), "")
    for name, broken in rules:
        out = out.when(broken, name)
    return out.otherwise("")


#: Fixed values of the policy: Kelly share, greatest share of the bank, least stake, least data quality.
KELLY, MOST, LEAST, QUALITY = 0.25, 0.05, 50.0, 50.0


def quoted_stake(bank: Column, odds: Column, p: Column, quality: Column, research: Column, confidence: Column, verdict: Column, contradictions: Column, risk: Column, room: Column) -> Column:
    """A struct of stake, share and reason: a Kelly share under a cap, lowered by the quality of what is known.

    A missing quality lowers nothing. A stake that was high enough before it was lowered is not pushed
    under the least stake.
    """
    share = F.least(P.kelly(p, odds, KELLY), F.lit(MOST))
    factor = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), quality) / 100.0), F.lit(1.0))
    factor = factor * F.coalesce(0.5 + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), research)), F.lit(1.0))
    factor = factor * F.coalesce(F.greatest(F.lit(0.25), F.least(F.lit(1.0), confidence)), F.lit(1.0))
    full = F.least(F.round(bank * share, 2), F.round(F.greatest(F.lit(0.0), room), 2), F.round(bank, 2))
    lowered = F.round(F.round(full * factor, 6), 2)  # the noise of the last digits decides no half cent
    stake = F.when((full >= LEAST) & (lowered > 0) & (lowered < LEAST), F.lit(LEAST)).otherwise(lowered)
    reason = chain(
        ("LLM_NO_BET", F.upper(verdict) == "NO_BET"), ("LLM_CONTRADICTION", contradictions > 0), ("CONTEXT_RISK", risk >= 0.7), ("NEGATIVE_EV", p * odds - 1 <= 0),
        ("QUALITY_TOO_LOW", quality < QUALITY), ("STAKE_TOO_LOW", stake < LEAST),
    )
    return F.struct(F.when(reason == "", stake).otherwise(0.0).alias("stake"), F.when(reason.isin("", "STAKE_TOO_LOW"), F.round(share, 4)).otherwise(0.0).alias("share"), reason.alias("reason"))


@query(f"""
WITH o AS (SELECT event_id, odds, p, CASE WHEN k % 3 > 0 THEN k + 20.0::DOUBLE END AS quality, CASE WHEN k % 4 > 0 THEN k / 100.0::DOUBLE END AS research, CASE WHEN k % 5 > 0 THEN p END AS confidence,
  CASE WHEN k % 17 = 0 THEN 'no_bet' END AS verdict, CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS contradictions, CASE WHEN k % 11 = 0 THEN 0.8 ELSE 0.1 END AS risk, CASE WHEN k % 2 = 0 THEN 300.0::DOUBLE ELSE 10000 END AS room FROM ({_E})),
s AS (SELECT *, least(CASE WHEN odds > 1 THEN greatest(0, (p * odds - 1) / (odds - 1)) * 0.25 ELSE 0 END, 0.05) AS share,
  coalesce(least(1, greatest(0, quality) / 100), 1) * coalesce(0.5 + 0.5 * least(1, greatest(0, research)), 1) * coalesce(greatest(0.25, least(1, confidence)), 1) AS factor FROM o),
f AS (SELECT *, least(round(10000 * share, 2), round(greatest(0, room), 2), 10000.0) AS full_ FROM s), l AS (SELECT *, round(round(full_ * factor, 6), 2) AS low FROM f),
t AS (SELECT *, CASE WHEN full_ >= 50 AND low > 0 AND low < 50 THEN 50.0::DOUBLE ELSE low END AS stake FROM l),
r AS (SELECT *, CASE WHEN upper(verdict) = 'NO_BET' THEN 'LLM_NO_BET' WHEN contradictions > 0 THEN 'LLM_CONTRADICTION' WHEN risk >= 0.7 THEN 'CONTEXT_RISK' WHEN p * odds - 1 <= 0 THEN 'NEGATIVE_EV'
  WHEN quality < 50 THEN 'QUALITY_TOO_LOW' WHEN stake < 50 THEN 'STAKE_TOO_LOW' ELSE '' END AS reason FROM t)
SELECT event_id, CASE WHEN reason = '' THEN stake ELSE 0 END AS stake, CASE WHEN reason IN ('', 'STAKE_TOO_LOW') THEN round(share, 4) ELSE 0 END AS share, reason FROM r
""")
def sc9_quoted_stake(spark, sf):
    """Stake and reason of each quote at a bank of 10,000."""
    k = F.col("k")
    some = lambda n, x: F.when(k % n > 0, x)
    quote = quoted_stake(
        F.lit(10000.0), F.col("odds"), F.col("p"), some(3, (k + 20).cast("double")), some(4, k / F.lit(100.0)), some(5, F.col("p")), F.when(k % 17 == 0, "no_bet"),
        F.when(k % 13 == 0, 1).otherwise(0), F.when(k % 11 == 0, 0.8).otherwise(0.1), F.when(k % 2 == 0, 300.0).otherwise(10000.0),
    )
    return offers(spark, sf).select("event_id", quote.alias("q")).select("event_id", "q.*")


@query(f"""
SELECT event_id, CASE WHEN k % 10 = 0 THEN 'SHADOW_MODEL_CANNOT_BET' WHEN event_type = 'error' THEN 'UNSUPPORTED_SPORT' WHEN odds < 1.05 OR odds > 5 THEN 'ODDS_OUT_OF_RANGE' WHEN stake <= 0 THEN 'INVALID_STAKE'
  WHEN stake > 10000 THEN 'STAKE_EXCEEDS_MAX_LIMIT' WHEN stake > 9000 THEN 'INSUFFICIENT_BANKROLL' ELSE '' END AS reason, CASE WHEN k % 10 > 0 AND event_type <> 'error' AND odds >= 1.05 AND odds <= 5 AND stake > 0 AND stake <= 9000
  THEN round(stake / 10000, 4) ELSE 1 END AS risk FROM (SELECT *, k * 125.0::DOUBLE - 500 AS stake FROM ({_E}))
""")
def fil12_proposals(spark, sf):
    """The first rule a proposal breaks, from what it carries alone, and its risk: its share of the greatest stake, 1 if rejected."""
    stake = F.col("k") * 125.0 - 500
    odds = F.col("odds")
    reason = chain(
        ("SHADOW_MODEL_CANNOT_BET", F.col("k") % 10 == 0), ("UNSUPPORTED_SPORT", F.col("event_type") == "error"), ("ODDS_OUT_OF_RANGE", ~odds.between(1.05, 5)), ("INVALID_STAKE", stake <= 0),
        ("STAKE_EXCEEDS_MAX_LIMIT", stake > 10000), ("INSUFFICIENT_BANKROLL", stake > 9000),
    )
    return offers(spark, sf).select("event_id", reason.alias("reason"), F.when(reason == "", F.round(stake / 10000, 4)).otherwise(1.0).alias("risk"))


@query(f"SELECT event_id FROM ({_E}) WHERE p - 1 / odds BETWEEN 0.02 AND 0.4 AND p BETWEEN 0.3 AND 0.9")
def fil14_edge_window(spark, sf):
    """Candidates whose edge and confidence are in their windows, both ends inside."""
    return offers(spark, sf).where(P.edge(F.col("p"), F.col("odds")).between(0.02, 0.4) & F.col("p").between(0.3, 0.9)).select("event_id")


@query("SELECT event_id, market FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 'match_winner' ELSE 'set_winner:' || (event_id % 3 + 1) END AS market FROM events) WHERE starts_with(market, 'set_winner:')")
def fil5_market_family(spark, sf):
    """One family of markets: a prefix of the name."""
    market = F.when(F.col("event_type") == "click", "match_winner").otherwise(F.concat(F.lit("set_winner:"), (F.col("event_id") % 3 + 1).cast("string")))
    return table(spark, sf, "events").select("event_id", market.alias("market")).where(F.col("market").startswith("set_winner:"))


_FIL16 = "SELECT event_id, p AS relevance, k % 2 = 0 AS a, k % 3 = 0 AS b, k % 5 = 0 AS noise, k % 4 = 0 AS signal, k % 7 = 0 AS hub, k % 6 = 1 AS about"


@query(f"""
SELECT event_id FROM ({_FIL16} FROM ({_E})) WHERE relevance >= 0.35 AND (a OR b) AND NOT (noise AND (NOT signal OR NOT (a AND b))) AND ((a AND b) OR hub OR (about AND relevance >= 0.45))
""")
def fil16_kept_pages(spark, sf):
    """Pages worth keeping: relevant, about a participant, not noise; both of them, a match hub, or a signal about the match."""
    k = F.col("k")
    a, b, noise, signal = k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 4 == 0
    keep = (F.col("p") >= 0.35) & (a | b) & ~(noise & ~(signal & a & b)) & ((a & b) | (k % 7 == 0) | ((k % 6 == 1) & (F.col("p") >= 0.45)))
    return offers(spark, sf).where(keep).select("event_id")


def columns_by_name(rows: DataFrame, names: list[str], strict: bool = False) -> DataFrame:
    """The named columns in the order of the names; missing ones are left out, or with ``strict`` an error."""
    missing = [n for n in names if n not in rows.columns]
    if strict and missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return rows.select(*[n for n in names if n in rows.columns])


def columns_of_families(rows: DataFrame, key: list[str], prefixes: list[str], without: bool = False) -> DataFrame:
    """The key and the columns whose names begin with a prefix, or ``without`` them: for ablations."""
    return rows.select(*key, *[c for c in rows.columns if c not in key and any(c.startswith(p) for p in prefixes) != without])


@query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem")
def fil21_columns_by_name(spark, sf):
    """A subset of columns; names that are not there are dropped, and the scan reads only the others."""
    return columns_by_name(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_absent", "l_tax"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def fil22_strict_columns(spark, sf):
    """A contract of columns; one that is absent is an error before anything is read."""
    return columns_by_name(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"], strict=True)


@query("SELECT l_orderkey, l_linenumber, l_discount, l_tax, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def fil23_without_family(spark, sf):
    """All features but two families, which are told by their prefixes."""
    return columns_of_families(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extended", "l_ship"], without=True)


_SET = "CASE WHEN (a = 6 AND b <= 4) OR (a = 7 AND b IN (5, 6)) THEN 'a' WHEN (b = 6 AND a <= 4) OR (b = 7 AND a IN (5, 6)) THEN 'b' END"


@query(f"""
WITH g AS (SELECT event_id, CASE WHEN k % 9 > 0 THEN k % 8 END AS a, CASE WHEN k % 9 > 0 THEN k // 8 % 8 END AS b, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS stored FROM ({_E}))
SELECT event_id FROM g WHERE a IS NULL OR b IS NULL OR {_SET} = stored
""")
def fil24_labels_agree(spark, sf):
    """Rows whose stored winner is the winner of the closed games; unknown games pass, open ones do not."""
    k = F.col("k")
    g = offers(spark, sf).select("event_id", F.when(k % 9 > 0, k % 8).alias("a"), F.when(k % 9 > 0, (F.floor(k / 8) % 8).cast("int")).alias("b"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("stored"))
    return g.where(F.col("a").isNull() | F.col("b").isNull() | (P.set_winner(F.col("a"), F.col("b")) == F.col("stored"))).select("event_id")


@query(f"SELECT event_id, CASE WHEN len(l) < 2 THEN CAST(0 AS DOUBLE) ELSE list_max(l) - list_min(l) END AS spread FROM (SELECT event_id, CASE WHEN k % 6 = 0 THEN [p] ELSE [p, 1 / odds, value / 500] END AS l FROM ({_E}))")
def sc48_disagreement(spark, sf):
    """How far the models' chances of one side lie apart; one model has no spread."""
    models = F.when(F.col("k") % 6 == 0, F.array("p")).otherwise(F.array("p", 1 / F.col("odds"), F.col("value") / 500))
    return offers(spark, sf).select("event_id", models.alias("l")).select("event_id", F.when(F.size("l") < 2, 0.0).otherwise(F.array_max("l") - F.array_min("l")).alias("spread"))


def _latin_sql(x: str) -> str:
    for letter, spelled in N.LATIN.items():
        if len(spelled) > 1:
            x = f"replace({x}, '{letter}', '{spelled}')"
    one = {k: v for k, v in N.LATIN.items() if len(v) == 1}
    return f"replace(replace(translate({x}, '{''.join(one)}', '{''.join(one.values())}'), 'ъ', ''), 'ь', '')"


@query(f"""
WITH t AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-zА-Яа-яЁё]{{3,}}'), lambda x: lower(x))) AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS w FROM t), l AS (SELECT doc_id, w, {_latin_sql('w')} AS l FROM p),
f AS (SELECT doc_id, unnest([w, l, CASE WHEN len(w) >= 5 THEN w[1:len(w) - 1] END, CASE WHEN len(w) >= 5 AND len(l) >= 5 THEN l[1:len(l) - 1] END]) AS f FROM l),
g AS (SELECT doc_id, string_agg(DISTINCT f, ' ' ORDER BY f) AS tokens FROM f WHERE len(f) >= 3 AND f NOT IN ('the', 'and', 'vs', 'атп', 'wta', 'atp', 'теннис', 'tennis') GROUP BY 1)
SELECT doc_id, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN g USING (doc_id)
""")
def sc34_name_tokens(spark, sf):
    """The name tokens of every whole text: words, their Latin spelling, and both without their last letter."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(N.name_tokens(F.col("text")), " ").alias("tokens"))


_ABOUT = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p.p_name AS name, a.p_name || ' vs ' || b.p_name || ': preview' AS title,
  CASE WHEN l_linenumber % 5 = 0 THEN 'https://x.org/person/' || replace(b.p_name, ' ', '-') || '?a=1' ELSE 'https://x.org/news/1' END AS url
  FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN part a ON a.p_partkey = l_suppkey JOIN part b ON b.p_partkey = l_orderkey % 97"""


@query(f"""
WITH t AS ({_ABOUT}), s AS (SELECT *, unnest(CASE WHEN url LIKE '%/person/%' THEN [replace(regexp_extract(url, '/person/([^/?#]+)', 1), '-', ' ')] ELSE string_split(split_part(title, ':', 1), ' vs ') END) AS side FROM t),
n AS (SELECT *, string_split(name, ' ') AS nw, string_split(side, ' ') AS w FROM s),
o AS (SELECT *, regexp_replace(nw[len(nw)], 'ez$', 'es') AS surname, substr(nw[1], 1, 1) AS letter, unnest(range(1, len(w) + 1)) AS i FROM n),
h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, bool_or(i = 1 OR regexp_replace(w[i - 1], 'ez$', 'es') = surname OR substr(w[i - 1], 1, 1) = letter) AS same,
  bool_or(i > 1 AND regexp_replace(w[i - 1], 'ez$', 'es') <> surname AND substr(w[i - 1], 1, 1) <> letter) AS other FROM o WHERE regexp_replace(w[i], 'ez$', 'es') = surname AND len(surname) >= 4 GROUP BY 1, 2, 3, 4)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN same AND other THEN 'both' WHEN same THEN 'same' WHEN other THEN 'other' ELSE 'absent' END AS about FROM t LEFT JOIN h USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)
""")
def sc62_namesakes(spark, sf):
    """Whether a page's title or address means the part of this name, another of the same surname, or both."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part").select("p_partkey", "p_name")
    named = lambda c: part.toDF(f"{c}_key", c)
    # A part's own name is read once a part, before it meets its lines.
    own = part.select(F.col("p_partkey").alias("name_key"), N.surnames_and_letters(F.col("p_name")).alias("own"))
    t = line.join(own, F.col("l_partkey") == F.col("name_key")).join(named("a"), F.col("l_suppkey") == F.col("a_key")).join(named("b"), F.col("l_orderkey") % 97 == F.col("b_key"))
    title = F.concat("a", F.lit(" vs "), "b", F.lit(": preview"))
    url = F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit("https://x.org/person/"), F.replace("b", F.lit(" "), F.lit("-")), F.lit("?a=1"))).otherwise("https://x.org/news/1")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.about_person(F.col("own"), title, url).alias("about"))


_PUBLISHED = [
    "<meta[^>]+property=.article:published_time.[^>]+content=.([^\"'']+)",
    "<meta[^>]+name=.(?:pubdate|publishdate|date).[^>]+content=.([^\"'']+)",
    "<time[^>]+datetime=.([^\"'']+)",
]
_HEAD = "CASE page_id % 4 WHEN 0 THEN '<meta property=\"article:published_time\" content=\"2024-03-0' || (page_id % 9 + 1) || 'T10:00:00Z\">' WHEN 1 THEN '<time datetime=\"2024-05-1' || (page_id % 9) || 'T08:30:00+02:00\">' WHEN 2 THEN '<meta name=\"date\" content=\"soon\">' ELSE '' END"


@query(f"""
WITH h AS (SELECT page_id, {_HEAD} || html AS h FROM pages), r AS (SELECT page_id, coalesce({", ".join(f"nullif(regexp_extract(h, '{p}', 1, 'i'), '')" for p in _PUBLISHED)}) AS raw FROM h)
SELECT page_id, epoch(TRY_CAST(raw AS TIMESTAMPTZ))::BIGINT AS published FROM r
""")
def sc30_published(spark, sf):
    """Seconds of the time of publication, from the first of three places in a page that names one; null if it does not parse."""
    raw = [F.nullif(F.regexp_extract("h", "(?i)" + p.replace("''", "'"), 1), F.lit("")) for p in _PUBLISHED]
    rows = table(spark, sf, "pages").select("page_id", F.concat(F.expr(_HEAD.replace("||", "||")), "html").alias("h")).select("page_id", F.coalesce(*raw).alias("raw"))
    return rows.select("page_id", F.expr("unix_seconds(try_cast(raw as timestamp))").alias("published"))


_EVIDENCE = "SELECT event_id, user_id, k % 3 = 0 AS no_hash, k % 5 = 0 AS no_source, k % 7 = 0 AS late, k % 11 = 0 AS no_time, event_type = 'view' AS live"


@query(f"""
WITH v AS ({_EVIDENCE} FROM ({_E})), g AS (SELECT user_id, event_id % 3 AS part, bool_or(no_time) AS t, bool_or(late AND NOT no_time) AS f, bool_or(no_source) AS s, bool_or(no_hash AND NOT (live AND NOT no_source)) AS h FROM v GROUP BY 1, 2),
a AS (SELECT user_id, 3 - count(*) AS missing, count(*) FILTER (t) AS timestamp_missing, count(*) FILTER (f) AS after_cutoff, count(*) FILTER (s) AS source_missing, count(*) FILTER (h) AS hash_missing FROM g GROUP BY 1)
SELECT *, missing + timestamp_missing + after_cutoff + source_missing + hash_missing = 0 AS certified FROM a
""")
def sc52_evidence(spark, sf):
    """For each forecast how many of three required groups lack evidence, a time, a source or a hash, or are from after the cutoff.

    A live state that names its source needs no archived bytes.
    """
    k = F.col("k")
    no_source, no_time = k % 5 == 0, k % 11 == 0
    g = offers(spark, sf).groupBy("user_id", (F.col("event_id") % 3).alias("part")).agg(
        F.bool_or(no_time).alias("t"), F.bool_or((k % 7 == 0) & ~no_time).alias("f"), F.bool_or(no_source).alias("s"), F.bool_or((k % 3 == 0) & ~((F.col("event_type") == "view") & ~no_source)).alias("h")
    )
    a = g.groupBy("user_id").agg((3 - F.count("*")).alias("missing"), *[F.count_if(c).alias(n) for c, n in (("t", "timestamp_missing"), ("f", "after_cutoff"), ("s", "source_missing"), ("h", "hash_missing"))])
    return a.withColumn("certified", F.expr("missing + timestamp_missing + after_cutoff + source_missing + hash_missing = 0"))


def match_side(won_a: Column, won_b: Column, sides: Column, even: Column, edge_side: Column, edge: Column, need: int = 2, least: float = 0.03) -> Column:
    """The side of the match from sets that are closed and ``sides`` of open ones (null: not confirmed), or null while it is contested."""
    count = lambda s: F.size(F.filter(sides, lambda x: x == s))
    add_a, add_b = count("a"), count("b")
    open_ = F.exists(sides, lambda x: x.isNull())
    side = F.when((won_a >= need) & (won_b < need), "a").when((won_b >= need) & (won_a < need), "b").when(open_ | (add_a + add_b == 0), F.lit(None))
    side = side.when((won_a + add_a >= need) & (won_b + add_b < need), "a").when((won_b + add_b >= need) & (won_a + add_a < need), "b")
    return F.when((even & (won_a == won_b)) | ((add_a > 0) & (add_b > 0)), F.lit(None)).when((edge_side == side) & (edge >= least), side)


@query(f"""
WITH s AS (SELECT event_id, k % 3 AS wa, k // 3 % 3 AS wb, [CASE k % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END, CASE k // 4 % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END][1:1 + k % 2] AS sides, k % 10 = 0 AS even,
  CASE WHEN event_type IN ('view', 'click') THEN 'a' ELSE 'b' END AS es, p - 0.2 AS edge FROM ({_E})),
c AS (SELECT *, len(list_filter(sides, lambda x: x = 'a')) AS aa, len(list_filter(sides, lambda x: x = 'b')) AS ab, len(list_filter(sides, lambda x: x IS NULL)) > 0 AS op FROM s),
d AS (SELECT *, CASE WHEN wa >= 2 AND wb < 2 THEN 'a' WHEN wb >= 2 AND wa < 2 THEN 'b' WHEN op OR aa + ab = 0 THEN NULL WHEN wa + aa >= 2 AND wb + ab < 2 THEN 'a' WHEN wb + ab >= 2 AND wa + aa < 2 THEN 'b' END AS side FROM c)
SELECT event_id, CASE WHEN (even AND wa = wb) OR (aa > 0 AND ab > 0) THEN NULL WHEN es = side AND edge >= 0.03 THEN side END AS side FROM d
""")
def sc54_match_side(spark, sf):
    """The match's side once closed and confirmed sets decide it and its own edge agrees."""
    k = F.col("k")
    named = lambda x: F.when(x == 0, "a").when(x == 1, "b")
    sides = F.slice(F.array(named(k % 4), named(F.floor(k / 4) % 3)), F.lit(1), 1 + k % 2)
    own = F.when(F.col("event_type").isin("view", "click"), "a").otherwise("b")
    return offers(spark, sf).select("event_id", match_side(k % 3, F.floor(k / 3) % 3, sides, k % 10 == 0, own, F.col("p") - 0.2).alias("side"))


@query("""
WITH g AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS live, avg(value) FILTER (event_type = 'error') AS range_, max(value) FILTER (event_type = 'click') AS ld, max(value) FILTER (event_type = 'error') AS rd FROM events GROUP BY 1)
SELECT user_id, CASE WHEN range_ IS NULL AND live IS NULL THEN NULL WHEN live IS NULL THEN 'range' WHEN range_ IS NULL THEN 'live' WHEN live >= range_ + 0.02 AND coalesce(ld, 0) <= coalesce(rd, 0) THEN 'live' ELSE 'range' END AS gate FROM g
""")
def t9_preferred_gate(spark, sf):
    """The plain range unless the other gate returns clearly more at no deeper drawdown."""
    side = lambda f, t: f(F.when(F.col("event_type") == t, F.col("value")))
    g = table(spark, sf, "events").groupBy("user_id").agg(side(F.avg, "click").alias("live"), side(F.avg, "error").alias("range"), side(F.max, "click").alias("ld"), side(F.max, "error").alias("rd"))
    better = (F.col("live") >= F.col("range") + 0.02) & (F.coalesce("ld", F.lit(0.0)) <= F.coalesce("rd", F.lit(0.0)))
    gate = F.when(F.col("range").isNull() & F.col("live").isNull(), F.lit(None)).when(F.col("live").isNull(), "range").when(F.col("range").isNull() | better, "live").otherwise("range")
    return g.select("user_id", gate.alias("gate"))


@query("""
WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (lower(event_type) IN ('p1', 'click', '1')) AS a, count(*) FILTER (lower(event_type) IN ('p2', 'view', '2')) AS b, avg(1 + value / 100) FILTER (event_type = 'click') AS oa FROM events GROUP BY 1)
SELECT user_id, n, a, b, n - a - b AS other, round(a / n::DOUBLE, 4) AS share_a, round(b / n::DOUBLE, 4) AS share_b, round(oa, 4) AS odds_a,
  CASE WHEN a / n::DOUBLE >= 0.6 THEN 'p1' WHEN b / n::DOUBLE >= 0.6 THEN 'p2' ELSE 'neutral' END AS pick, round(least(1, n / 5.0::DOUBLE) * greatest(a, b) / n::DOUBLE, 4) AS confidence FROM g
""")
def ag43_exact_consensus(spark, sf):
    """Shares of exactly named outcomes, the pick at 60 %, and a confidence that grows up to five forecasts."""
    n = F.col("n").cast("double")
    kind = F.lower("event_type")
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(kind.isin("p1", "click", "1")).alias("a"), F.count_if(kind.isin("p2", "view", "2")).alias("b"), F.avg(F.when(F.col("event_type") == "click", 1 + F.col("value") / 100)).alias("oa"))
    a, b = F.col("a") / n, F.col("b") / n
    pick = F.when(a >= 0.6, "p1").when(b >= 0.6, "p2").otherwise("neutral")
    return g.select("user_id", "n", "a", "b", F.expr("n - a - b").alias("other"), F.round(a, 4).alias("share_a"), F.round(b, 4).alias("share_b"), F.round("oa", 4).alias("odds_a"), pick.alias("pick"), F.round(F.least(F.lit(1.0), n / 5) * F.greatest("a", "b") / n, 4).alias("confidence"))


@query("""
WITH b AS (SELECT l_returnflag AS market, l_orderkey, l_discount > 0.05 AS won, l_quantity AS stake, 1 + l_tax * 20 AS odds, l_linestatus = 'O' AS rejected FROM lineitem),
p AS (SELECT *, CASE WHEN rejected THEN 0 WHEN won THEN stake * (odds - 1) ELSE -stake END AS pnl FROM b)
SELECT market, count(*) FILTER (NOT rejected) AS bets, count(*) FILTER (NOT rejected AND won) AS wins, sum(stake) FILTER (NOT rejected) AS turnover, sum(pnl) AS pnl, sum(pnl) / sum(stake) FILTER (NOT rejected) AS roi,
  count(*) FILTER (rejected AND won) AS rejected_winners, count(*) FILTER (rejected AND NOT won) AS rejected_losers, count(DISTINCT l_orderkey) AS matches_seen, count(DISTINCT l_orderkey) FILTER (NOT rejected) AS matches_bet FROM p GROUP BY 1
""")
def ag32_replay_summary(spark, sf):
    """Bets, return, rejections by kind and the funnel of matches of a replay, by market."""
    rejected, won = F.col("l_linestatus") == "O", F.col("l_discount") > 0.05
    pnl = F.when(rejected, 0.0).when(won, F.col("l_quantity") * (F.col("l_tax") * 20)).otherwise(-F.col("l_quantity"))
    b = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("market"), "l_orderkey", won.alias("won"), F.col("l_quantity").alias("stake"), rejected.alias("rejected"), pnl.alias("pnl"))
    # Counts of matches are taken from one row a market and match, so that no task gathers a market's keys.
    once = b.groupBy("market", "l_orderkey").agg(
        F.count_if(~F.col("rejected")).alias("bets"), F.count_if(F.expr("not rejected and won")).alias("wins"), F.sum(F.when(~F.col("rejected"), F.col("stake"))).alias("turnover"), F.sum("pnl").alias("pnl"),
        F.count_if(F.expr("rejected and won")).alias("rw"), F.count_if(F.expr("rejected and not won")).alias("rl"),
    )
    return once.groupBy("market").agg(
        F.sum("bets").alias("bets"), F.sum("wins").alias("wins"), F.sum("turnover").alias("turnover"), F.sum("pnl").alias("pnl"), (F.sum("pnl") / F.sum("turnover")).alias("roi"),
        F.sum("rw").alias("rejected_winners"), F.sum("rl").alias("rejected_losers"), F.count("*").alias("matches_seen"), F.count_if(F.col("bets") > 0).alias("matches_bet"),
    )


@query("""
WITH b AS (SELECT user_id, event_type = 'error' AS vetoed, CASE WHEN value > 60 THEN value / 100 ELSE -1 END AS pnl FROM events), a AS (SELECT user_id, count(*) AS n, sum(pnl) AS plain, count(*) FILTER (NOT vetoed) AS kept, coalesce(sum(pnl) FILTER (NOT vetoed), 0) AS with_veto FROM b GROUP BY 1)
SELECT count(*) AS groups, sum(n) AS bets, sum(kept) AS bets_with_veto, sum(plain) / sum(n) AS roi, sum(with_veto) / sum(kept) AS roi_with_veto, avg(with_veto - plain) AS mean_gain, count(*) FILTER (with_veto > plain) AS better FROM a
""")
def ag45_paired_report(spark, sf):
    """The same bets with and without a veto, paired by group."""
    pnl = F.when(F.col("value") > 60, F.col("value") / 100).otherwise(-1.0)
    kept = F.col("event_type") != "error"
    a = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(pnl).alias("plain"), F.count_if(kept).alias("kept"), F.coalesce(F.sum(F.when(kept, pnl)), F.lit(0.0)).alias("with_veto"))
    return a.agg(
        F.count("*").alias("groups"), F.sum("n").alias("bets"), F.sum("kept").alias("bets_with_veto"), (F.sum("plain") / F.sum("n")).alias("roi"), (F.sum("with_veto") / F.sum("kept")).alias("roi_with_veto"),
        F.avg(F.col("with_veto") - F.col("plain")).alias("mean_gain"), F.count_if(F.col("with_veto") > F.col("plain")).alias("better"),
    )


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' AND l_quantity > 25 THEN 'pending' WHEN l_returnflag = 'R' THEN 'void' WHEN (l_suppkey % 2 = 0) = (l_returnflag = 'A') THEN 'won' ELSE 'lost' END AS status FROM lineitem
""")
def st21_journal(spark, sf):
    """Pending entries settle once the winner is known: void without one, else won or lost."""
    status = F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 25), "pending").when(F.col("l_returnflag") == "R", "void").when((F.col("l_suppkey") % 2 == 0) == (F.col("l_returnflag") == "A"), "won").otherwise("lost")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", status.alias("status"))


def definitive(status: Column, winner: Column, retired: Column, walkover: Column, score: Column) -> Column:
    """Whether an official result is complete: called off, or finished with a winner and a score of two sets or more."""
    head = F.split(F.trim(score), " ")[0]
    sets = F.array(F.regexp_extract(head, r"^(\d)[:-](\d)$", 1), F.regexp_extract(head, r"^(\d)[:-](\d)$", 2)).cast("array<int>")
    known = F.coalesce(winner, F.lit("")) != ""
    over = (F.greatest(sets[0], sets[1]) >= 2) & (sets[0] != sets[1])
    played = status.isin("FINISHED", "RETIRED") & (known | retired | walkover) & (F.coalesce(head, F.lit("")) != "") & ~head.isin("0:0", "0-0", "-:-")
    return F.coalesce(status.isin("CANCELLED", "VOID") | (played & ((status == "RETIRED") | retired | F.coalesce(over, F.lit(False)))), F.lit(False))


_ST23 = "SELECT event_id, ['FINISHED', 'RETIRED', 'CANCELLED', 'SETTLEMENT_REVIEW_REQUIRED', 'FINISHED'][k % 5 + 1] AS status, CASE WHEN k % 4 > 0 THEN 'a' END AS winner, k % 7 = 0 AS retired, k % 11 = 0 AS walkover, ['2:1 (6-4)', '1:0', '0:0', '', '0-2 (4-6)', '1:1'][k % 6 + 1] AS score"


@query(f"""
SELECT event_id FROM ({_ST23} FROM ({_E})) WHERE status = 'CANCELLED' OR (status IN ('FINISHED', 'RETIRED') AND (winner IS NOT NULL OR retired OR walkover) AND score NOT IN ('', '0:0') AND (status = 'RETIRED' OR retired OR score IN ('2:1 (6-4)', '0-2 (4-6)')))
""")
def st23_definitive(spark, sf):
    """Results that are safe to settle on."""
    k = F.col("k")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    rows = offers(spark, sf).select(
        "event_id", pick(["FINISHED", "RETIRED", "CANCELLED", "SETTLEMENT_REVIEW_REQUIRED", "FINISHED"], 5).alias("status"), F.when(k % 4 > 0, "a").alias("winner"),
        (k % 7 == 0).alias("retired"), (k % 11 == 0).alias("walkover"), pick(["2:1 (6-4)", "1:0", "0:0", "", "0-2 (4-6)", "1:1"], 6).alias("score"),
    )
    return rows.where(definitive(F.col("status"), F.col("winner"), F.col("retired"), F.col("walkover"), F.col("score"))).select("event_id")


@query(f"""
WITH o AS (SELECT event_id, odds, p, least(0.99, p * 0.9 + 0.05) AS s, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS y FROM ({_E})),
d AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS a FROM o GROUP BY 1), e AS (SELECT CAST(least(floor(s * 10), 9) AS INTEGER) AS bin, count(*) AS b FROM o GROUP BY 1), t AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM o),
q AS (SELECT sum((pb - pa) * ln(pb / pa)) AS psi FROM (SELECT greatest(coalesce(a, 0) / n, 1e-4) AS pa, greatest(coalesce(b, 0) / n, 1e-4) AS pb FROM range(10) r(i) CROSS JOIN t LEFT JOIN d ON d.bin = i LEFT JOIN e ON e.bin = i)),
b AS (SELECT count(*) AS n, avg(abs(s - p)) AS mean_difference, avg((s - y) * (s - y)) - avg((p - y) * (p - y)) AS brier_delta, count(*) FILTER (s * odds - 1 >= 0.02) AS bets,
  sum(CASE WHEN y = 1 THEN odds - 1 ELSE -1 END) FILTER (s * odds - 1 >= 0.02) / count(*) FILTER (s * odds - 1 >= 0.02) AS roi FROM o)
SELECT n, psi, mean_difference, brier_delta, bets, roi, n >= 100 AND psi <= 0.25 AND roi >= 0 AND brier_delta <= 0.02 AS promoted FROM b, q
""")
def ag17_shadow_report(spark, sf):
    """Drift, paired difference, calibration, counterfactual return and the verdict on a shadow model."""
    p, s, y, odds = F.col("p"), F.col("s"), F.col("y"), F.col("odds")
    o = offers(spark, sf).select("odds", "p", F.least(F.lit(0.99), F.col("p") * 0.9 + 0.05).alias("s"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("y"))
    both = o.select(F.explode(F.array(F.struct(p.alias("p"), F.lit(False).alias("current")), F.struct(s.alias("p"), F.lit(True).alias("current")))).alias("x")).select("x.*")
    bet = s * odds - 1 >= 0.02
    b = o.agg(
        F.count("*").alias("n"), F.avg(F.abs(s - p)).alias("mean_difference"), (F.avg((s - y) * (s - y)) - F.avg((p - y) * (p - y))).alias("brier_delta"), F.count_if(bet).alias("bets"),
        (F.sum(F.when(bet, F.when(y == 1, odds - 1).otherwise(-1.0))) / F.count_if(bet)).alias("roi"),
    )
    return b.join(M.psi(both)).withColumn("promoted", F.expr("n >= 100 and psi <= 0.25 and roi >= 0 and brier_delta <= 0.02"))
