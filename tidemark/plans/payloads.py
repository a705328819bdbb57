"""Nested payloads, score texts and point rows flattened to tables, and the state features of each sport.

Payloads are built from the driver's tables and parsed again, so the parsers meet whole JSON texts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import series as S
from ..sources.shared import cut, new_path
from ..sources.tables import table
from .policies import _E, offers
from .registry import query


@query("""
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01' AND o_orderdate <= TIMESTAMP '1996-06-01' + INTERVAL 48 HOUR
""")
def src3_within_horizon(spark, sf):
    """Entries of a feed that begin within 48 hours of the time it was read."""
    feed = table(spark, sf, "orders").select(F.to_json(F.struct("o_orderkey", "o_orderdate")).alias("j"))
    rows = feed.select(F.from_json("j", "o_orderkey long, o_orderdate timestamp_ntz").alias("j")).select("j.*")
    seen = "timestamp_ntz '1996-06-01'"
    return rows.where(f"o_orderdate > {seen} and o_orderdate <= {seen} + interval 48 hours")


#: Parts of a comment that mean retirement, and that the match was not played.
RETIRED, NOT_PLAYED = ["отказ", "травм", "снял", "rt"], ["не сост", "отмен", "дисквал", "walkover", "wo", "w.o."]


def result_of_text(score: Column, comment: Column) -> Column:
    """A struct of winner (a, b or null) and status of a score text such as "2:1 (6-4 3-6 6-1)"."""
    text = F.lower(F.concat_ws(" ", F.trim(score), comment))
    any_of = lambda words: F.array_contains(F.array(*[F.contains(text, F.lit(w)) for w in words]), True)
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(F.trim(score), r"^(\d)\s*[:-]\s*(\d)(?:\s|$)", i), F.lit("")), F.lit("9")).cast("int")
    a, b = part(1), part(2)
    ahead = F.when(a > b, "a").when(b > a, "b")
    retired, whole = any_of(RETIRED), F.coalesce((F.greatest(a, b) >= 2) & (a != b), F.lit(False))
    status = F.when(any_of(NOT_PLAYED), "CANCELLED").when(retired, F.when(ahead.isNotNull(), "RETIRED").otherwise("VOID")).when(whole, "FINISHED").otherwise("SETTLEMENT_REVIEW_REQUIRED")
    return F.struct(F.when(status.isin("RETIRED", "FINISHED"), ahead).alias("winner"), status.alias("status"))


_SCORES = [
    ("2:1 (6-4 3-6 6-1)", "", "a", "FINISHED"), ("0-2 (4-6 2-6)", "", "b", "FINISHED"), ("1:0", "", None, "SETTLEMENT_REVIEW_REQUIRED"), ("1:0 (6-4)", "отказ", "a", "RETIRED"), ("1:1", "травма", None, "VOID"),
    ("", "не состоялся", None, "CANCELLED"), ("-:-", "", None, "SETTLEMENT_REVIEW_REQUIRED"), ("1 - 3 ", "", "b", "FINISHED"), ("W.O.", "", None, "CANCELLED"), ("", "снялся", None, "VOID"), ("2:2", "", None, "SETTLEMENT_REVIEW_REQUIRED"),
]


def _scores_sql() -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v + "'"
    rows = ", ".join(f"({i}, {quoted(w)}, {quoted(s)})" for i, (_, _, w, s) in enumerate(_SCORES))
    return f"SELECT event_id, winner, status FROM events JOIN (VALUES {rows}) t(i, winner, status) ON event_id % {len(_SCORES)} = i"


@query(_scores_sql())
def src7_result_texts(spark, sf):
    """Winner and status of official score texts and comments: retirements, walkovers, leads that decide nothing."""
    pick = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in _SCORES]), (F.col("event_id") % len(_SCORES) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", result_of_text(pick(0), pick(1)).alias("r")).select("event_id", "r.*")


@query(f"""
WITH r AS (SELECT event_id, event_type AS sport, k % 5 AS a, k // 5 % 5 AS b FROM ({_E}))
SELECT sport, count(*) AS n, count(*) FILTER (a > b) AS won_a, count(*) FILTER (b > a) AS won_b, count(*) FILTER (a = b AND sport = 'view') AS draws, count(*) FILTER (a = b AND sport <> 'view') AS review FROM r GROUP BY 1
""")
def src6_results_by_sport(spark, sf):
    """An official results document parsed to one row a match; a draw is a result in one sport and open in the others."""
    k = F.col("k")
    doc = offers(spark, sf).select(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("sport"), F.concat_ws(":", k % 5, F.floor(k / 5) % 5).alias("score"))).alias("j"))
    r = doc.select(F.from_json("j", "id long, sport string, score string").alias("j")).select("j.*")
    r = r.select("sport", F.split("score", ":")[0].cast("int").alias("a"), F.split("score", ":")[1].cast("int").alias("b"))
    draw, football = F.col("a") == F.col("b"), F.col("sport") == "view"
    return r.groupBy("sport").agg(F.count("*").alias("n"), F.count_if(F.expr("a > b")).alias("won_a"), F.count_if(F.expr("b > a")).alias("won_b"), F.count_if(draw & football).alias("draws"), F.count_if(draw & ~football).alias("review"))


@query(f"""
SELECT event_id, CASE WHEN k % 7 > 0 THEN event_id END AS id, CASE WHEN k % 7 > 0 THEN k END AS score, k % 7 = 0 AS bad FROM ({_E})
""")
def src8_csv_rows(spark, sf):
    """Lines of a CSV file with a fixed schema; a line that does not parse is kept and marked."""
    k = F.col("k")
    line = F.concat_ws(",", F.when(k % 7 == 0, F.lit("x")).otherwise(F.col("event_id").cast("string")), k.cast("string"))
    rows = offers(spark, sf).select("event_id", F.from_csv(line, "id long, score int, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("c"))
    bad = F.col("c._bad").isNotNull()
    return rows.select("event_id", F.when(~bad, F.col("c.id")).alias("id"), F.when(~bad, F.col("c.score")).alias("score"), bad.alias("bad"))


_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity"


@query(f"""
WITH l AS (SELECT l_orderkey, l_linenumber AS n, lag(l_linenumber) OVER (PARTITION BY l_orderkey {_ORDER}) AS p, row_number() OVER (PARTITION BY l_orderkey {_ORDER}) AS place FROM lineitem)
SELECT l_orderkey, place, n, CASE WHEN p IS NULL AND n > 1 THEN 'starts_late' WHEN n = p THEN 'repeated' WHEN n > p + 1 THEN 'gap' END AS reason FROM l
""")
def src9_point_rows(spark, sf):
    """Points in order; where the numbers do not follow each other the reason is kept, not the row dropped."""
    w = S.by_time("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    n, p = F.col("l_linenumber"), F.lag("l_linenumber").over(w)
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.row_number().over(w).cast("long").alias("place"), n.alias("n"), p.alias("p"))
    return rows.select("l_orderkey", "place", "n", F.expr("case when p is null and n > 1 then 'starts_late' when n = p then 'repeated' when n > p + 1 then 'gap' end").alias("reason"))


@query("SELECT conv_id, count(*) AS turns, string_agg(turn || ':' || role, '|' ORDER BY turn, role) AS document FROM conversations GROUP BY 1")
def src10_documents(spark, sf):
    """One document a conversation, its turns in order. A document is as long as its conversation: nothing larger is held."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), turns.alias("t"))
    return rows.select("conv_id", "turns", F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"])), "|").alias("document"))


_SETS = "array<struct<games: array<array<int>>>>"


@query(f"""
WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey {_ORDER}) - 1 AS i, l_linenumber AS a, CAST(l_quantity AS INTEGER) % 4 AS b FROM lineitem),
p AS (SELECT l_orderkey, i // 2 AS set_, i % 2 AS game, 0 AS point, a AS v FROM r UNION ALL SELECT l_orderkey, i // 2, i % 2, 1, b FROM r)
SELECT l_orderkey, CAST(set_ AS INTEGER) AS set_, CAST(game AS INTEGER) AS game, CAST(point AS INTEGER) AS point, v, lag(v) OVER (PARTITION BY l_orderkey ORDER BY set_, game, point) AS before FROM p
""")
def src14_transitions(spark, sf):
    """Sets of games of points, three arrays deep, flattened to transitions from each point to the next."""
    w = S.by_time("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    r = table(spark, sf, "lineitem").select("l_orderkey", (F.row_number().over(w) - 1).alias("i"), F.array(F.col("l_linenumber"), F.col("l_quantity").cast("int") % 4).alias("points"))
    sets = r.groupBy("l_orderkey", F.floor(F.col("i") / 2).alias("s")).agg(F.sort_array(F.collect_list(F.struct("i", "points"))).alias("g"))
    sets = sets.select("l_orderkey", "s", F.struct(F.transform("g", lambda x: x["points"]).alias("games")).alias("set"))
    docs = sets.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("s", "set"))).alias("d"))
    docs = docs.select("l_orderkey", F.to_json(F.struct(F.transform("d", lambda x: x["set"]).alias("sets"))).alias("j"))
    s = docs.select("l_orderkey", F.posexplode(F.from_json("j", f"sets {_SETS}")["sets"]).alias("set_", "set"))
    g = s.select("l_orderkey", "set_", F.posexplode("set.games").alias("game", "points"))
    p = g.select("l_orderkey", "set_", "game", F.posexplode("points").alias("point", "v"))
    return p.withColumn("before", F.lag("v").over(S.by_time("l_orderkey", "set_", "game", "point")))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 3 > 0 OR o_orderkey % 5 > 0")
def src16_appended(spark, sf):
    """New rows joined to a store in the order of their start, without those that are to be skipped: ranges of time, one file each."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    store, new = o.where("o_orderkey % 3 > 0"), o.where("o_orderkey % 3 = 0 and o_orderkey % 5 > 0")
    return cut(store.unionByName(new).repartitionByRange("o_orderdate").sortWithinPartitions("o_orderdate", "o_orderkey"), "store")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (7, 70, 700, 1400)")
def src17_wanted_ids(spark, sf):
    """Only the rows of wanted ids; the filter reaches the row groups and pages of the files."""
    return table(spark, sf, "orders").where(F.col("o_orderkey").isin(7, 70, 700, 1400)).select("o_orderkey", "o_totalprice")


@query("""
WITH e AS (SELECT event_id, least(user_id, other) AS a, greatest(user_id, other) AS b, event_type AS surface, date_diff('day', TIMESTAMP '2024-01-01', ts) // 7 AS week FROM (SELECT *, event_id % 97 AS other FROM events))
SELECT event_id FROM e n WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.event_id % 2 = 0 AND o.a = n.a AND o.b = n.b AND o.surface = n.surface AND abs(o.week - n.week) <= 1)
""")
def src24_unseen_matches(spark, sf):
    """Matches of one source that another does not have: the same pair on the same surface within a week."""
    other = F.col("event_id") % 97
    week = F.floor(F.date_diff("ts", F.lit("2024-01-01").cast("date")) / 7)
    e = table(spark, sf, "events").select("event_id", F.least("user_id", other).alias("a"), F.greatest("user_id", other).alias("b"), F.col("event_type").alias("surface"), week.alias("week"))
    # Each known match stands in three weeks, so the join is one of equal keys.
    known = e.where("event_id % 2 = 0").select("a", "b", "surface", F.explode(F.expr("array(week - 1, week, week + 1)")).alias("week")).distinct()
    return e.where("event_id % 2 = 1").join(known, ["a", "b", "surface", "week"], "left_anti").select("event_id")


@query(f"""
SELECT event_id, CASE WHEN k % 4 > 0 THEN k % 3 ELSE k % 2 END AS sets_a, CASE WHEN k % 4 > 0 THEN k // 3 % 3 ELSE 0 END AS sets_b, CASE WHEN k % 5 > 0 THEN 'a' ELSE 'unknown' END AS server FROM ({_E})
""")
def src26_state_contract(spark, sf):
    """A nested state read to a fixed contract: the detailed part first, then the flat one, then the defaults."""
    k = F.col("k")
    score = F.when(k % 4 > 0, F.struct((k % 3).alias("a"), (F.floor(k / 3) % 3).alias("b")))
    payload = F.to_json(F.struct(F.struct(score.alias("score"), F.when(k % 5 > 0, "a").alias("server")).alias("live"), (k % 2).alias("sets_a")))
    rows = offers(spark, sf).select("event_id", F.from_json(payload, "live struct<score: struct<a: int, b: int>, server: string>, sets_a int, sets_b int").alias("j"))
    first = lambda *names, default: F.coalesce(*[F.col(f"j.{n}") for n in names], F.lit(default))
    return rows.select("event_id", first("live.score.a", "sets_a", default=0).alias("sets_a"), first("live.score.b", "sets_b", default=0).alias("sets_b"), first("live.server", default="unknown").alias("server"))


#: What the providers call the markets of each sport.
MARKETS = {
    "football": {"1X2": "match_winner", "Total": "total_goals", "Handicap": "handicap"},
    "basketball": {"Winner": "match_winner", "Total": "total_points", "Handicap": "handicap"},
    "hockey": {"1X2": "regulation_winner", "Total": "total_goals", "Puck line": "handicap"},
    "volleyball": {"Winner": "match_winner", "Total": "total_points", "Sets": "set_handicap"},
}
_PAYLOAD = "markets array<struct<name: string, line: double, suspended: boolean, selections: array<struct<side: string, price: double>>>>"


def flat_markets(payloads: DataFrame, key: str, payload: str, names: dict[str, str]) -> DataFrame:
    """key, market, line, side, price: one row a price above 1 of the known markets that are not suspended."""
    m = payloads.select(key, F.explode(F.from_json(payload, _PAYLOAD)["markets"]).alias("m")).where("not coalesce(m.suspended, false)")
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = m.select(key, F.element_at(known, F.col("m.name")).alias("market"), F.col("m.line").alias("line"), F.explode("m.selections").alias("s")).where("market is not null and s.price > 1")
    return rows.select(key, "market", "line", F.col("s.side").alias("side"), F.col("s.price").alias("price"))


def _market_query(name: str, sport: str):
    (winner, total, handicap), places = list(MARKETS[sport].items()), 3 if "1X2" in MARKETS[sport] else 2
    draw = f"UNION ALL SELECT event_id, '{winner[1]}', NULL, 'draw', 1 + k / 10.0::DOUBLE FROM e WHERE k > 0" if places == 3 else ""
    sql = f"""WITH e AS ({_E})
SELECT event_id, '{winner[1]}' AS market, CAST(NULL AS DOUBLE) AS line, 'a' AS side, odds AS price FROM e WHERE odds > 1 UNION ALL SELECT event_id, '{winner[1]}', NULL, 'b', 2.5 FROM e {draw}
UNION ALL SELECT event_id, '{total[1]}', k % 4 + 0.5, s, 1.9 FROM e, (VALUES ('over'), ('under')) t(s) WHERE k % 3 > 0
UNION ALL SELECT event_id, '{handicap[1]}', (0 - k % 3)::DOUBLE, 'a', 1.8 FROM e"""

    def run(spark, sf):
        k = F.col("k")
        price = lambda side, p: F.struct(F.lit(side).alias("side"), p.cast("double").alias("price"))
        market = lambda n, line, off, *s: F.struct(F.lit(n).alias("name"), line.cast("double").alias("line"), off.alias("suspended"), F.array(*s).alias("selections"))
        three = [price("draw", 1 + k / 10)] if places == 3 else []
        payload = F.to_json(F.struct(F.array(
            market(winner[0], F.lit(None), F.lit(False), price("a", F.col("odds")), price("b", F.lit(2.5)), *three), market(total[0], k % 4 + 0.5, k % 3 == 0, price("over", F.lit(1.9)), price("under", F.lit(1.9))),
            market(handicap[0], -(k % 3), F.lit(False), price("a", F.lit(1.8)), price("b", F.lit(1.0))), market("Corners", F.lit(9.5), F.lit(False), price("over", F.lit(2.0))),
        ).alias("markets")))
        return flat_markets(offers(spark, sf).select("event_id", payload.alias("j")), "event_id", "j", MARKETS[sport])

    run.__name__ = name
    run.__doc__ = f"The winner, total and handicap markets of a {sport} payload."
    return query(sql)(run)


src28_football_markets = _market_query("src28_football_markets", "football")
src29_basketball_markets = _market_query("src29_basketball_markets", "basketball")
src30_hockey_markets = _market_query("src30_hockey_markets", "hockey")
src31_volleyball_markets = _market_query("src31_volleyball_markets", "volleyball")


@query("SELECT l_orderkey, l_returnflag AS market, CAST(l_linenumber AS BIGINT) AS selection, l_extendedprice AS price FROM lineitem WHERE l_extendedprice > 1")
def src27_markets_and_prices(spark, sf):
    """A payload of markets with selections with prices, flattened level by level."""
    one = F.struct(F.col("l_linenumber").cast("long").alias("selection"), F.col("l_extendedprice").alias("price"))
    m = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(one).alias("s"))
    docs = m.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("l_returnflag").alias("market"), F.col("s").alias("selections"))).alias("markets"))).alias("j"))
    kind = "markets array<struct<market: string, selections: array<struct<selection: long, price: double>>>>"
    m = docs.select("l_orderkey", F.explode(F.from_json("j", kind)["markets"]).alias("m"))
    return m.select("l_orderkey", "m.market", F.explode("m.selections").alias("s")).select("l_orderkey", "market", "s.*").where("price > 1")


def copy_pages(rows: DataFrame, key: str, path: str, page: int) -> int:
    """Append the rows of the next ``page`` keys after the highest one in the table at ``path``; returns how many.

    The table is its own cursor: a page is there as a whole or not at all, so a copy that was cut off
    goes on where it stopped.
    """
    spark = rows.sparkSession
    try:
        mark = spark.read.parquet(path).agg(F.max(key)).first()[0]
    except AnalysisException as missing:  # no page has been written yet
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        mark = None
    left = rows if mark is None else rows.where(F.col(key) > mark)
    last = left.select(key).distinct().orderBy(key).limit(page).agg(F.max(key)).first()[0]
    new = left.where(F.col(key) <= last) if last is not None else left.limit(0)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey <= (SELECT max(k) FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem ORDER BY 1 LIMIT 300))")
def src32_resumed_copy(spark, sf):
    """Three pages of a hundred orders, each beginning where the one before ended."""
    rows, path = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), new_path(spark, "pages")
    for _ in range(3):
        copy_pages(rows, "l_orderkey", path, 100)
    return spark.read.schema(rows.schema).parquet(path)


# ------------------------------------------------------------------ state features of each sport


def three_way(a: Column, x: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    """Fair shares of three prices and the margin; a missing draw counts nothing, a missing side gives (0.5, 0, 0.5, 0)."""
    chance = lambda o: F.when(o > 1, 1 / o).otherwise(0.0)
    total, ok = chance(a) + chance(x) + chance(b), (a > 1) & (b > 1)
    share = lambda o, other: F.when(ok, F.round(chance(o) / total, 4)).otherwise(other)
    return share(a, 0.5), share(x, 0.0), share(b, 0.5), F.when(ok, F.greatest(F.lit(0.0), total - 1)).otherwise(0.0)


_SHARE3 = "WITH o AS (SELECT event_id, k, odds AS a, CASE WHEN k % 4 > 0 THEN 3.4 ELSE 0 END::DOUBLE AS x, CASE WHEN k % 9 > 0 THEN 2.9 ELSE 1 END::DOUBLE AS b, k % 4 AS ga, k // 4 % 4 AS gb, k % 95 AS minute, event_id % 5 + 1 AS period FROM ({e})), c AS (SELECT *, CASE WHEN a > 1 THEN 1 / a ELSE 0 END AS pa, CASE WHEN x > 1 THEN 1 / x ELSE 0 END AS px, CASE WHEN b > 1 THEN 1 / b ELSE 0 END AS pb, a > 1 AND b > 1 AS ok FROM o)"


@query(_SHARE3.format(e=_E) + """
SELECT event_id, CASE WHEN ok THEN round(pa / (pa + px + pb), 4) ELSE 0.5 END AS fair_a, CASE WHEN ok THEN round(px / (pa + px + pb), 4) ELSE 0 END AS fair_x, CASE WHEN ok THEN round(pb / (pa + px + pb), 4) ELSE 0.5 END AS fair_b,
  CASE WHEN ok THEN greatest(0, pa + px + pb - 1) ELSE 0 END AS margin, ga - gb AS goal_diff, minute >= 75 AND abs(ga - gb) <= 1 AS clutch, period >= 2 AS second_half, period = 3 AS extra_time, period >= 4 AS penalties,
  round((ga + 1) / (ga + gb + 2)::DOUBLE, 4) AS shots_ratio FROM c
""")
def u12_football_features(spark, sf):
    """Three-way shares, and the clock, period and shots of a football match."""
    k = F.col("k")
    fair_a, fair_x, fair_b, margin = three_way(F.col("odds"), F.when(k % 4 > 0, 3.4).otherwise(0.0), F.when(k % 9 > 0, 2.9).otherwise(1.0))
    ga, gb, period = k % 4, F.floor(k / 4) % 4, F.col("event_id") % 5 + 1
    return offers(spark, sf).select(
        "event_id", fair_a.alias("fair_a"), fair_x.alias("fair_x"), fair_b.alias("fair_b"), margin.alias("margin"), (ga - gb).alias("goal_diff"), ((k % 95 >= 75) & (F.abs(ga - gb) <= 1)).alias("clutch"),
        (period >= 2).alias("second_half"), (period == 3).alias("extra_time"), (period >= 4).alias("penalties"), F.round((ga + 1) / (ga + gb + 2), 4).alias("shots_ratio"),
    )


@query(f"""
WITH q AS (SELECT event_id, event_id % 4 + 1 AS q, k * 12 AS clock, CASE WHEN k % 6 > 0 THEN [k % 30, k % 25] END AS qa, CASE WHEN k % 6 > 0 THEN [k % 28, k % 27] END AS qb, k AS sa, k // 2 AS sb FROM ({_E})),
p AS (SELECT *, CASE WHEN coalesce(list_sum(qa), 0) + coalesce(list_sum(qb), 0) > 0 THEN list_sum(qa) ELSE sa END AS a, CASE WHEN coalesce(list_sum(qa), 0) + coalesce(list_sum(qb), 0) > 0 THEN list_sum(qb) ELSE sb END AS b FROM q)
SELECT event_id, CAST(a - b AS BIGINT) AS margin, CAST(a + b AS BIGINT) AS total, round((a + b) / greatest(1, (q - 1) * 10 + least(10, clock / 60.0::DOUBLE)) * 40, 1) AS pace, q >= 4 AND abs(a - b) <= 5 AS crunch, q >= 3 AS second_half FROM p
""")
def u13_basketball_features(spark, sf):
    """Points over the quarters (else of the score text), the pace projected to 40 minutes, and crunch time."""
    k = F.col("k")
    quarters = lambda m, n: F.when(k % 6 > 0, F.aggregate(F.array(k % m, k % n), F.lit(0), lambda s, x: s + x))
    rows = offers(spark, sf).select("event_id", (F.col("event_id") % 4 + 1).alias("q"), (k * 12).alias("clock"), quarters(30, 25).alias("qa"), quarters(28, 27).alias("qb"), F.concat_ws(":", k, F.floor(k / 2)).alias("text"))
    said = F.coalesce(F.col("qa") + F.col("qb"), F.lit(0)) > 0
    of_text = lambda i: F.regexp_extract("text", r"(\d+)[:\-](\d+)", i).cast("int")
    rows = rows.withColumn("a", F.when(said, F.col("qa")).otherwise(of_text(1)).cast("long")).withColumn("b", F.when(said, F.col("qb")).otherwise(of_text(2)).cast("long"))
    elapsed = F.greatest(F.lit(1.0), (F.col("q") - 1) * 10.0 + F.least(F.lit(10.0), F.col("clock") / 60))
    margin, total = F.col("a") - F.col("b"), F.col("a") + F.col("b")
    return rows.select("event_id", margin.alias("margin"), total.alias("total"), F.round(total / elapsed * 40, 1).alias("pace"), ((F.col("q") >= 4) & (F.abs(margin) <= 5)).alias("crunch"), (F.col("q") >= 3).alias("second_half"))


@query(f"""
WITH s AS (SELECT event_id, k % 4 AS a, k // 4 % 4 AS b, event_id % 5 + 1 AS period, k % 30 AS sa, k % 23 AS sb, CASE k % 5 WHEN 0 THEN 'team_a' WHEN 1 THEN '2' WHEN 2 THEN 'home' END AS side FROM ({_E}))
SELECT event_id, a - b AS goal_diff, round((sa + 1) / (sa + sb + 2)::DOUBLE, 4) AS shots_ratio, coalesce(side IN ('team_a', 'home', '1'), false) AS power_a, coalesce(side IN ('team_b', 'away', '2'), false) AS power_b,
  period = 4 AS overtime, period >= 5 AS shootout, period = 3 AND abs(a - b) <= 1 AS clutch FROM s
""")
def u14_hockey_features(spark, sf):
    """Goals, shots with one added on each side, power plays by team token, overtime, shootout and clutch time."""
    k = F.col("k")
    a, b, period, sa, sb = k % 4, F.floor(k / 4) % 4, F.col("event_id") % 5 + 1, k % 30, k % 23
    side = F.when(k % 5 == 0, "team_a").when(k % 5 == 1, "2").when(k % 5 == 2, "home")
    power = lambda *names: F.coalesce(side.isin(*names), F.lit(False))
    return offers(spark, sf).select(
        "event_id", (a - b).alias("goal_diff"), F.round((sa + 1) / (sa + sb + 2), 4).alias("shots_ratio"), power("team_a", "home", "1").alias("power_a"), power("team_b", "away", "2").alias("power_b"),
        (period == 4).alias("overtime"), (period >= 5).alias("shootout"), ((period == 3) & (F.abs(a - b) <= 1)).alias("clutch"),
    )


@query(f"""
WITH s AS (SELECT event_id, k, event_id % 5 + 1 AS set_, [k % 25, k % 24, k % 23] AS pa, [k % 22, k % 21, k % 26] AS pb FROM ({_E}))
SELECT event_id, k % 3 - k // 3 % 3 AS sets_diff, pa[-1] - pb[-1] AS points_diff, CAST(list_sum(pa) - list_sum(pb) AS BIGINT) AS total_diff, set_ = 5 OR k % 13 = 0 AS tiebreak_set, k % 17 = 0 AS match_point, k % 3 - k % 2 AS timeouts_diff FROM s
""")
def u15_volleyball_features(spark, sf):
    """Sets and points of the set in play and of all sets, the deciding set, match point and timeouts."""
    k = F.col("k")
    sets = F.array(*[F.struct((k % m).alias("a"), (k % n).alias("b")) for m, n in ((25, 22), (24, 21), (23, 26))])
    rows = offers(spark, sf).select("event_id", "k", sets.alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda x, e: x + e["a"] - e["b"])
    last = F.element_at("s", -1)
    return rows.select(
        "event_id", (k % 3 - F.floor(k / 3) % 3).alias("sets_diff"), (last["a"] - last["b"]).alias("points_diff"), total.alias("total_diff"), ((F.col("event_id") % 5 + 1 == 5) | (k % 13 == 0)).alias("tiebreak_set"),
        (k % 17 == 0).alias("match_point"), (k % 3 - k % 2).alias("timeouts_diff"),
    )


@query("""
WITH e AS (SELECT user_id, bool_or(event_type = 'error' AND value > 400) AS injury, bool_or(event_type = 'signup' AND value > 450) AS tired, count(*) FILTER (event_type = 'click') AS pages, avg(value) / 1000 - 0.05 AS edge, least(0.9, avg(value) / 180) AS p FROM events GROUP BY 1)
SELECT user_id, CASE WHEN injury THEN 'INJURY_RISK' WHEN tired THEN 'SCHEDULE_FATIGUE' WHEN (pages = 0 AND edge >= 0.04 AND p >= 0.58) OR (pages > 0 AND edge > 0.02 AND p >= 0.52) THEN 'MODEL_EDGE' WHEN pages = 0 THEN 'MARGINAL_EDGE_NO_RESEARCH' ELSE 'MARGINAL_EDGE' END AS reason,
  CASE WHEN injury THEN greatest(0.2, p - 0.3) WHEN tired THEN greatest(0.3, p - 0.2) WHEN (pages = 0 AND edge >= 0.04 AND p >= 0.58) OR (pages > 0 AND edge > 0.02 AND p >= 0.52) THEN least(0.95, p + CASE WHEN pages > 0 THEN 0.05 ELSE 0 END) ELSE 0.5 END AS confidence FROM e
""")
def u19_rule_verdict(spark, sf):
    """A verdict from the flags of what was read and from the edge: risks first, then an edge that is higher without research."""
    kind, v = F.col("event_type"), F.col("value")
    e = table(spark, sf, "events").groupBy("user_id").agg(
        F.bool_or((kind == "error") & (v > 400)).alias("injury"), F.bool_or((kind == "signup") & (v > 450)).alias("tired"), F.count_if(kind == "click").alias("pages"),
        (F.avg("value") / 1000 - 0.05).alias("edge"), F.least(F.lit(0.9), F.avg("value") / 180).alias("p"),
    )
    none, p = F.col("pages") == 0, F.col("p")
    bet = F.when(none, (F.col("edge") >= 0.04) & (p >= 0.58)).otherwise((F.col("edge") > 0.02) & (p >= 0.52))
    reason = F.when(F.col("injury"), "INJURY_RISK").when(F.col("tired"), "SCHEDULE_FATIGUE").when(bet, "MODEL_EDGE").when(none, "MARGINAL_EDGE_NO_RESEARCH").otherwise("MARGINAL_EDGE")
    sure = F.when(F.col("injury"), F.greatest(F.lit(0.2), p - 0.3)).when(F.col("tired"), F.greatest(F.lit(0.3), p - 0.2)).when(bet, F.least(F.lit(0.95), p + F.when(none, 0.0).otherwise(0.05))).otherwise(0.5)
    return e.select("user_id", reason.alias("reason"), sure.alias("confidence"))


@query(f"""
WITH t AS (SELECT ln((p + 0.01) / (1.01 - p)) AS z, unnest([CASE WHEN k % 3 > 0 THEN k % 2 END, CASE WHEN k % 4 > 0 THEN k // 2 % 2 END]) AS y, 1 + k % 2 AS w FROM ({_E}))
SELECT sum(w * (greatest(z, 0) - z * y + ln(1 + exp(-abs(z))))) / sum(w) AS loss, count(*) AS n FROM t WHERE y IS NOT NULL
""")
def u26_masked_loss(spark, sf):
    """Weighted cross entropy of several targets of a row; targets without a label take no part."""
    k, p = F.col("k"), F.col("p")
    labels = F.array(F.when(k % 3 > 0, k % 2), F.when(k % 4 > 0, (F.floor(k / 2) % 2).cast("int")))
    t = offers(spark, sf).select(F.ln((p + 0.01) / (1.01 - p)).alias("z"), F.explode(labels).alias("y"), (1 + k % 2).alias("w")).where("y is not null")
    loss = F.greatest(F.col("z"), F.lit(0.0)) - F.col("z") * F.col("y") + F.log1p(F.exp(-F.abs("z")))
    return t.agg((F.sum(F.col("w") * loss) / F.sum("w")).alias("loss"), F.count("*").alias("n"))


@query(f"""
WITH s AS (SELECT event_id, 1 / (1 + exp(-(4 * p - 2))) AS live, 1 / (1 + exp(-(3 * p - 1.2 - value / 1000))) AS shadow, odds FROM ({_E}))
SELECT event_id, live, shadow, shadow - live AS shift, (live * odds - 1 >= 0.02) <> (shadow * odds - 1 >= 0.02) AS disagree FROM s
""")
def u27_two_models(spark, sf):
    """Two models' chances of one vector side by side, and where their decisions part."""
    p = F.col("p")
    s = offers(spark, sf).select("event_id", "odds", (1 / (1 + F.exp(-(4 * p - 2)))).alias("live"), (1 / (1 + F.exp(-(3 * p - 1.2 - F.col("value") / 1000)))).alias("shadow"))
    bets = lambda m: F.col(m) * F.col("odds") - 1 >= 0.02
    return s.select("event_id", "live", "shadow", (F.col("shadow") - F.col("live")).alias("shift"), (bets("live") != bets("shadow")).alias("disagree"))
