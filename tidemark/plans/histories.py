"""Point histories and results of matches read back from text feeds and HTML pages, and merges of season files.

Feeds and pages of points are written from the same games: an order is a match, each of its lines a game whose points follow
one of six courses, and every third order has a tie-break. The SQL gives the events of these games
without any feed or page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.points import point_events
from ..sources.histories import feed_games, page_games
from ..sources.merging import upsert
from ..sources.results import result_rows
from ..sources.shared import new_path
from ..sources.tables import table
from .registry import query

#: The courses of a game, its winner's points first; the fourth leaves a point out, the fifth has no points, the sixth ends too early.
COURSES = [
    ["15:0", "30:0", "40:0"], ["15:0", "15:15", "30:15", "40:15"], ["0:15", "15:15", "30:15", "30:30", "40:30", "40:40", "A:40", "40:40", "A:40"], ["15:0", "40:0"], [], ["15:0", "30:0"],
]
TIE = ["1:0", "1:1", "2:1", "3:1", "4:1", "5:1", "6:1", "7:1"]


def _turned(text: str) -> str:
    return ":".join(reversed(text.split(":")))


def _courses(column: Column, turned: bool) -> Column:
    return F.get(F.array(*[F.array(*[F.lit(_turned(p) if turned else p) for p in c]).cast("array<string>") for c in COURSES]), column)


def lines(spark, sf) -> DataFrame:
    """doc, k (the game's place), set_no, side, a, b, server, states: games with the score after each; a few scores are told wrong."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.row_number().over(w) - 1).alias("k"), (F.col("l_suppkey") % 2).cast("int").alias("side"), (F.col("l_partkey") % 6).cast("int").alias("course"), "l_quantity")
    rows = rows.withColumn("set_no", (F.floor(F.col("k") / 4) + 1).cast("int"))
    own = Window.partitionBy("doc", "set_no").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = F.sum(1 - F.col("side")).over(own).cast("int") + F.when(F.col("l_quantity") % 9 == 0, 1).otherwise(0)
    states = F.when(F.col("side") == 0, _courses(F.col("course"), False)).otherwise(_courses(F.col("course"), True))
    return rows.select("doc", "k", "set_no", "side", a.alias("a"), F.sum("side").over(own).cast("int").alias("b"), (F.col("k") % 2).cast("int").alias("server"), states.alias("states"))


def feeds(spark, sf) -> DataFrame:
    """doc, payload."""
    g = lines(spark, sf)
    code = lambda c: (F.col(c) + 1).cast("string")
    field = lambda k, v: F.concat(F.lit(k + "÷"), v, F.lit("¬"))
    game = F.concat(field("HC", F.col("a").cast("string")), field("HE", F.col("b").cast("string")), field("HG", code("server")), field("HL", F.concat(F.array_join("states", ","), F.when(F.col("k") % 3 == 0, "|B1").otherwise(""))), field("HK", code("side")))
    title = F.when(F.col("k") % 4 == 0, F.concat(F.lit("HA÷"), F.when(F.col("set_no") % 2 == 0, F.concat("set_no", F.lit("-й сет"))).otherwise(F.concat(F.lit("Set "), "set_no")), F.lit("¬~"))).otherwise("")
    tie = "~HB÷Tiebreak - Set 1¬~" + "~".join(f"HC÷{p.split(':')[0]}¬HE÷{p.split(':')[1]}¬HG÷1¬" for p in TIE)
    own = g.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("k", F.concat(title, game).alias("r")))).alias("r"))
    return own.select("doc", F.concat(F.lit("A1÷x¬~"), F.array_join("r.r", "~"), F.when(F.col("doc") % 3 == 0, tie).otherwise("")).alias("payload"))


def pages(spark, sf) -> DataFrame:
    """doc, html."""
    g = lines(spark, sf)
    c = "matchHistoryRow"
    side = F.when(F.col("server") == 0, "home").otherwise("away")
    serve = F.concat(F.lit(f'<div class="{c}__servis {c}__home"></div><div class="{c}__servis {c}__highlight {c}__'), side, F.lit('"><svg><path d="M0"></svg></div>'))
    points = F.array_join(F.transform("states", lambda s: F.concat(F.lit(f'<div class="{c}__fifteen">'), s, F.lit(',<span class="badge">BP 40:0</span></div>'))), "")
    row = F.concat(
        F.lit(f'<div class="{c} x">'), serve, F.lit(f'<div class="{c}__scoreBox"><span>'), "a", F.lit("</span>-<span>"), "b", F.lit(f'</span></div></div><div class="{c}__fifteens">'), points,
        F.lit(f'<div class="{c}__gameResult">{{}}</div></div>'),
    )
    title = F.when(F.col("k") % 4 == 0, F.concat(F.lit('</div><div><h3 class="sectionHeader">Point by point &ndash; Set <b>'), "set_no", F.lit("</b></h3>"))).otherwise("")
    cell = '<span data-testid="wcl-pointByPointScore" data-winning="{}">{}</span>'
    tie, before = '</div><div><h3 class="sectionHeader">Tiebreak &mdash; Set 1</h3>', [0, 0]
    for p in TIE:
        now = [int(x) for x in p.split(":")]
        cells = "".join(cell.format("true" if now[i] > before[i] else "false", now[i]) for i in (0, 1))
        tie, before = tie + f'<div class="{c}"><i class="{c}__servis {c}__highlight {c}__home"></i>{cells}</div>', now
    own = g.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("k", F.concat(title, row).alias("r")))).alias("r"))
    return own.select("doc", F.concat(F.lit("<html><body><div><p>menu"), F.array_join("r.r", "\n"), F.when(F.col("doc") % 3 == 0, tie).otherwise(""), F.lit("</div><footer>40:0</footer></body></html>")).alias("html"))


def _expected(strict: bool) -> str:
    places = {"0": 0, "15": 1, "30": 2, "40": 3, "A": 4}
    names = ["0", "15", "30", "40", "AD"]
    rows = []
    for n, course in enumerate(COURSES):
        before = (0, 0)
        for i, text in enumerate(course):
            after = tuple(places[x] for x in text.split(":"))
            step = (after[0] - before[0], after[1] - before[1])
            winner = {(1, 0): 0, (0, 1): 1, (-1, 0): 1, (0, -1): 0}.get(step)
            rows.append((n, i, *before, *after, "NULL" if winner is None else winner))
            before = after
    values = ", ".join(str(r).replace("'NULL'", "NULL") for r in rows)
    ends = ", ".join(f"({n}, {len(c)}, {'0' if len(c) > 2 else '1' if n == 3 else '2'})" for n, c in enumerate(COURSES))  # 2: no side could end it
    show = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    tie, before = [], (0, 0)
    for k, p in enumerate(TIE):
        now = tuple(int(x) for x in p.split(":"))
        tie.append((k, f"{before[0]}:{before[1]}", p, int(now[1] > before[1])))
        before = now
    reads = """
  UNION ALL SELECT doc, k, set_no, NULL, NULL, NULL, server, NULL, 'game_score_transition_missing_or_invalid' FROM c WHERE done IS NULL""" if strict else ""
    return f"""
WITH l AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS k, l_suppkey % 2 AS side, l_partkey % 6 AS course, l_quantity FROM lineitem),
g AS (SELECT *, k // 4 + 1 AS set_no, k % 2 AS server FROM l),
s AS (SELECT *, sum(1 - side) OVER w + CASE WHEN l_quantity % 9 = 0 THEN 1 ELSE 0 END AS a, sum(side) OVER w AS b FROM g WINDOW w AS (PARTITION BY doc, set_no ORDER BY k)),
p AS (SELECT *, a - coalesce(lag(a) OVER w, 0) AS da, b - coalesce(lag(b) OVER w, 0) AS db FROM s WINDOW w AS (PARTITION BY doc, set_no ORDER BY k)),
c AS (SELECT *, CASE WHEN da = 1 AND db = 0 THEN 0 WHEN da = 0 AND db = 1 THEN 1 END AS done FROM p),
t(course, i, ba, bb, aa, ab, w) AS (VALUES {values}), e(course, n, kind) AS (VALUES {ends}), q(k, before, after, winner) AS (VALUES {', '.join(map(str, tie))}), names AS (SELECT {show} AS n),
x AS (SELECT c.*, i, CASE side WHEN 0 THEN ba ELSE bb END AS ba, CASE side WHEN 0 THEN bb ELSE ba END AS bb, CASE side WHEN 0 THEN aa ELSE ab END AS aa, CASE side WHEN 0 THEN ab ELSE aa END AS ab, CASE WHEN side = 0 THEN w ELSE 1 - w END AS w FROM c JOIN t USING (course)),
d AS (SELECT c.*, n, kind, kind < 2 AND done = side AS proved, (SELECT max(i) FROM t WHERE t.course = c.course) AS i FROM c JOIN e USING (course)),
m AS (SELECT doc, max(k) + 1 AS n FROM c GROUP BY 1),
r AS (
  SELECT doc, k AS seq, set_no, i, n[ba + 1] || ':' || n[bb + 1] AS before, n[aa + 1] || ':' || n[ab + 1] AS after, server, w AS winner, CASE WHEN w IS NULL THEN 'ambiguous' ELSE 'confirmed' END AS what FROM x, names
  UNION ALL SELECT d.doc, d.k, d.set_no, d.n, names.n[aa + 1] || ':' || names.n[ab + 1], d.a || ':' || d.b, d.server, d.side, 'terminal_from_game_result' FROM d JOIN x ON x.doc = d.doc AND x.k = d.k AND x.i = d.i, names WHERE coalesce(proved, false)
  UNION ALL SELECT doc, k, set_no, NULL, NULL, NULL, server, NULL, 'ambiguous_terminal_point' FROM d WHERE n > 0 AND NOT coalesce(proved, false)
  UNION ALL SELECT doc, k, set_no, NULL, NULL, NULL, server, NULL, 'point_sequence_missing' FROM d WHERE n = 0{reads}
  UNION ALL SELECT doc, n + q.k, 1, q.k, before, after, 0, winner, 'confirmed' FROM m, q WHERE doc % 3 = 0
  UNION ALL SELECT doc, n + 7, 1, NULL, '7:1', '7:6', 0, 0, 'terminal_from_tiebreak_result' FROM m WHERE doc % 3 = 0
)
SELECT doc, CAST(set_no AS INTEGER) AS set_no, CAST(i AS INTEGER) AS i, before, after, CAST(server AS INTEGER) AS server, CAST(winner AS INTEGER) AS winner, what{', CAST(seq AS INTEGER) AS seq' if strict else ''} FROM r
"""


@query(_expected(False))
def src12_feed_points(spark, sf):
    """Point events and named gaps of every text feed."""
    games, gaps = feed_games(feeds(spark, sf))
    found = point_events(games, strict=False)
    none = lambda kind: F.lit(None).cast(kind)
    bare = gaps.select("doc", "seq", "set_no", none("int").alias("i"), none("string").alias("before"), none("string").alias("after"), none("int").alias("server"), none("int").alias("winner"), "what")
    return found.union(bare).select("doc", "set_no", "i", "before", "after", "server", "winner", "what")


@query(_expected(True))
def src13_page_points(spark, sf):
    """Point events and named gaps of every page."""
    games, gaps = page_games(pages(spark, sf))
    found = point_events(games, strict=True)
    none = lambda kind: F.lit(None).cast(kind)
    bare = gaps.select("doc", "seq", "set_no", none("int").alias("i"), none("string").alias("before"), none("string").alias("after"), none("int").alias("server"), none("int").alias("winner"), "what")
    return found.union(bare).select("doc", "set_no", "i", "before", "after", "server", "winner", "what", "seq")


_EVENTS = ["ATP Challenger Lyon", "ITF Women Cairo", "WTA Rome", "ATP Madrid", "Exhibition Cup"]


def result_pages(spark, sf) -> DataFrame:
    """doc, html: a page for each customer with a table of its orders as matches."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("long").alias("price"))
    event = F.get(F.array(*map(F.lit, _EVENTS)), (F.col("o_orderkey") % 5).cast("int"))
    first = F.col("o_orderstatus") == "F"
    done = F.col("o_orderstatus") != "P"
    link = lambda who, k: F.concat(F.lit('<td class="t-name"><a href="/player/'), who, F.lit(f'-x{k}/">'), who, F.lit(f" X.{k}</a></td>"))
    who = lambda k: F.concat(F.lit(f"p{k}"), (F.col("price") % (90 + k)).cast("string"))
    cell = lambda c, v: F.concat(F.lit(f'<td class="{c}">'), v, F.lit("</td>"))
    won, lost = F.when(first, "2").otherwise("1"), F.when(first, "0").when(done, "2").otherwise("1")
    note = F.when(F.col("price") % 13 == 0, ' <i title="Retired">*</i>').otherwise("")
    one = F.concat(F.lit('<tr class="bott"><td class="first time">12:30</td>'), link(who(1), 1), cell("result", won), cell("score", F.lit("6")), cell("score", F.lit("7")), cell("score", F.when(first, "&nbsp;").otherwise("3")), F.lit('<td><a href="/match-detail/?id='), (F.col("o_orderkey") + 1).cast("string"), F.lit('">info</a>'), note, F.lit("</td></tr>"))
    two = F.concat(F.lit("<tr>"), link(who(2), 2), cell("result", lost), cell("score", F.lit("4")), cell("score", F.lit("6<sup>5</sup>")), cell("score", F.when(first, "").otherwise("6")), F.lit("</tr>"))
    head = F.concat(F.lit('<tr class="head flags"><td class="t-name" colspan=2><a href="/lyon/2024/">'), event, F.lit("</a></td></tr>"))
    rows = o.select("o_custkey", F.struct("o_orderkey", F.concat(head, one, two).alias("r")).alias("r")).groupBy("o_custkey").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return rows.select(F.col("o_custkey").alias("doc"), F.concat(F.lit('<title>Results</title><table class="menu"><tr><td>x</table><table class="result">'), F.array_join("r.r", "\n"), F.lit("</table>")).alias("html"))


@query("""
WITH o AS (SELECT *, floor(o_totalprice)::BIGINT AS price, ['ATP Challenger Lyon', 'ITF Women Cairo', 'WTA Rome', 'ATP Madrid', 'Exhibition Cup'][o_orderkey % 5 + 1] AS event FROM orders),
r AS (SELECT *, CASE WHEN price % 13 = 0 THEN 'not_played_out' WHEN o_orderstatus = 'P' THEN 'not_decided' WHEN o_orderkey % 5 = 4 THEN 'event_unknown' END AS reason,
  'p1' || price % 91 AS one, 'p2' || price % 92 AS two, o_orderstatus = 'F' AS won FROM o)
SELECT o_custkey AS doc, CAST(o_orderkey + 1 AS VARCHAR) AS match_id, event, ['challenger', 'itf', 'wta', 'atp', 'unknown'][o_orderkey % 5 + 1] AS tour, ['m', 'w', 'w', 'm', 'unknown'][o_orderkey % 5 + 1] AS gender, '12:30' AS time,
  CASE WHEN reason IS NULL THEN CASE WHEN won THEN one || '-x1' ELSE two || '-x2' END END AS winner_id, CASE WHEN reason IS NULL THEN CASE WHEN won THEN two || '-x2' ELSE one || '-x1' END END AS loser_id,
  CASE WHEN reason IS NULL THEN CASE WHEN won THEN one || ' X.1' ELSE two || ' X.2' END END AS winner, CASE WHEN reason IS NULL THEN CASE WHEN won THEN two || ' X.2' ELSE one || ' X.1' END END AS loser,
  CASE WHEN reason IS NULL THEN CASE WHEN won THEN '6-4 7-6(5)' ELSE '4-6 6(5)-7 6-3' END END AS score, CASE WHEN reason IS NULL THEN 3 END AS best_of, reason FROM r
""")
def src11_result_table(spark, sf):
    """The matches of every page's result table, and why the others are left out."""
    return result_rows(result_pages(spark, sf))


@query("""
WITH f AS (SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS status, year(o_orderdate) AS season, 1 AS version FROM orders),
c AS (SELECT o_orderkey, price + 1 AS price, status, season + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS season, 2 AS version FROM f WHERE status = 'P' UNION ALL SELECT o_orderkey + 10000000, price, 'N', season, 2 FROM f WHERE status = 'F')
SELECT o_orderkey, price, status, CAST(season AS INTEGER) AS season, version FROM f WHERE status <> 'P' UNION ALL SELECT o_orderkey, price, status, CAST(season AS INTEGER), version FROM c
""")
def src22_bulk_upsert(spark, sf):
    """Season files merged into one table: a first load, corrections that move some rows to another season, new rows, and the same file once more."""
    o = table(spark, sf, "orders")
    first = o.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("season"), F.lit(1).alias("version"))
    moved = first.where("status = 'P'").withColumns({"price": F.col("price") + 1, "season": F.col("season") + F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0), "version": F.lit(2)})
    new = first.where("status = 'F'").withColumns({"o_orderkey": F.col("o_orderkey") + 10_000_000, "status": F.lit("N"), "version": F.lit(2)})
    path = new_path(spark, "seasons")
    for changes in (first, moved.union(new), moved.union(new)):
        upsert(path, changes, ["o_orderkey"], "season", "version")
    return spark.read.schema(first.schema).parquet(path).select(first.columns)
