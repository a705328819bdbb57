"""Score texts, boards, names and labels.

Scores are spelled from the keys of ``orders``, boards from ``events``, names from ``part``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import prices as P
from ..functions import scores as S
from ..sources.tables import table
from .registry import query

_SCORE = """CASE WHEN o_orderkey % 5 = 0 THEN concat(o_orderkey % 7, '-', o_custkey % 7)
  ELSE concat(o_orderkey % 8, '-', o_custkey % 8, ' ', o_orderkey % 3 + 5, '(4) - ', o_custkey % 4 + 4, CASE WHEN o_orderkey % 3 = 0 THEN ' ret.' ELSE '' END) END"""
_SCORES = f"SELECT o_orderkey, {_SCORE} AS score FROM orders"
_PAIRS = r"list_transform(regexp_extract_all({}, '\d+\s*[-:]\s*\d+'), lambda p: {{'a': CAST(regexp_extract(p, '(\d+)\D+(\d+)', 1) AS INTEGER), 'b': CAST(regexp_extract(p, '(\d+)\D+(\d+)', 2) AS INTEGER)}})"
_WON = "CASE WHEN ({0}.a = 6 AND {0}.b <= 4) OR ({0}.a = 7 AND {0}.b IN (5, 6)) THEN 'a' WHEN ({0}.b = 6 AND {0}.a <= 4) OR ({0}.b = 7 AND {0}.a IN (5, 6)) THEN 'b' END"
_GOT = "len(list_filter({0}, lambda g: g.{1} > g.{2}))"


def _scored(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(_SCORE).alias("score"))


@query(f"""
WITH s AS (SELECT o_orderkey, score, regexp_replace(score, '[\\[(]\\s*\\d+\\s*[\\])]', '', 'g') AS bare FROM ({_SCORES})),
g AS (SELECT o_orderkey, {_PAIRS.format("bare")} AS l FROM s),
t AS (SELECT o_orderkey, len(l) = 1 AND l[1].a <= 5 AND l[1].b <= 5 AS single, l, {_GOT.format("l", "a", "b")} AS a, {_GOT.format("l", "b", "a")} AS b FROM g)
SELECT o_orderkey, CAST(CASE WHEN single THEN l[1].a WHEN a + b > 0 THEN a END AS INTEGER) AS won, CAST(CASE WHEN single THEN l[1].b WHEN a + b > 0 THEN b END AS INTEGER) AS lost FROM t
""")
def sc21_set_tally(spark, sf):
    """Sets of both sides; one small pair is a tally already."""
    bare = F.regexp_replace("score", r"[\[(]\s*\d+\s*[\])]", "")
    return _scored(spark, sf).select("o_orderkey", S.set_tally(bare).alias("t")).select("o_orderkey", F.col("t.a").alias("won"), F.col("t.b").alias("lost"))


@query(f"""
WITH s AS (SELECT o_orderkey, '2:' || (o_orderkey % 3) || ' (' || (o_orderkey % 8) || '-' || (o_custkey % 8) || ' 6:' || (o_custkey % 7) || ' 7-' || (o_orderkey % 7) || ')' AS text FROM orders),
g AS (SELECT o_orderkey, {_PAIRS.format(chr(10) + "regexp_extract(text, '[(](.*)[)]', 1)")} AS g FROM s),
w AS (SELECT o_orderkey, list_transform(g, lambda x: coalesce({_WON.format("x")}, '')) AS w FROM g)
SELECT o_orderkey, array_to_string(CASE WHEN list_contains(w, '') THEN w[1:list_position(w, '') - 1] ELSE w END, ',') AS winners FROM w
""")
def sc55_set_winners(spark, sf):
    """Winners of the sets in brackets, up to the first set that is not finished."""
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(F.lit("2:"), a % 3, F.lit(" ("), a % 8, F.lit("-"), b % 8, F.lit(" 6:"), b % 7, F.lit(" 7-"), a % 7, F.lit(")"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(S.winners_in_brackets(text), ",").alias("winners"))


@query(f"""
WITH s AS (SELECT o_orderkey, score AS x, concat(o_orderkey % 3, '-', o_custkey % 3) AS y FROM ({_SCORES}) JOIN orders USING (o_orderkey)),
g AS (SELECT o_orderkey, {_PAIRS.format("regexp_replace(x, '[(][0-9]+[)]', '', 'g')")} AS x, {_PAIRS.format("y")} AS y FROM s),
t AS (SELECT *, {_GOT.format("x", "a", "b")} AS a, {_GOT.format("x", "b", "a")} AS b FROM g)
SELECT o_orderkey, x = y OR (len(x) >= 2 AND ((y[1].a = a AND y[1].b = b) OR (y[1].a = b AND y[1].b = a))) AS agree FROM t
""")
def sc56_scores_agree(spark, sf):
    """A detailed score against a summary of its sets, either way round."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(_SCORE).alias("x"), F.concat(F.col("o_orderkey") % 3, F.lit("-"), F.col("o_custkey") % 3).alias("y"))
    return rows.select("o_orderkey", S.scores_agree(F.col("x"), F.col("y")).alias("agree"))


_LINE = '{{"games_a": {}, "games_b": {}, "live": {}}}'
_BOARD = "concat('[" + ", ".join(_LINE.format(f"', (event_id + {i}) % 8, '", f"', (user_id + {2 * i}) % 8, '", f"', {live}, '") for i, live in enumerate(["'false'", "CASE WHEN event_type = 'view' THEN 'true' ELSE 'false' END", "'false'"])) + "]')"
_BOARDS = f"""
b AS (SELECT event_id, event_id % 5 AS current, from_json({_BOARD}, '[{{"games_a": "INTEGER", "games_b": "INTEGER", "live": "BOOLEAN"}}]') AS l FROM events),
p AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: x.live), true), 0) AS m FROM b),
c AS (SELECT *, CASE WHEN m > 0 THEN m ELSE len(l) END AS pos, list_filter(l, lambda x, i: i <> CASE WHEN m > 0 THEN m ELSE len(l) END) AS closed FROM p),
s AS (SELECT event_id, current, len(list_filter(closed, lambda g: g.games_a > g.games_b)) AS sets_a, len(list_filter(closed, lambda g: g.games_b > g.games_a)) AS sets_b,
  l[pos].games_a AS games_a, l[pos].games_b AS games_b FROM c)"""


def _boards(spark, sf):
    lines = F.from_json(F.expr(_BOARD), "array<struct<games_a: int, games_b: int, live: boolean>>")
    rows = table(spark, sf, "events").select("event_id", (F.col("event_id") % 5).alias("current"), S.board(lines).alias("b"))
    return rows.select("event_id", "current", "b.*")


@query(f"WITH {_BOARDS} SELECT * EXCLUDE current FROM s")
def sc16_board(spark, sf):
    """Sets and games of a nested board."""
    return _boards(spark, sf).drop("current")


@query(f"""
WITH {_BOARDS}
SELECT event_id, greatest(sets_a, sets_b) >= CASE WHEN current >= 4 OR (sets_a >= 2 AND sets_b >= 2) THEN 3 ELSE 2 END AND current <= sets_a + sets_b AS decided FROM s
""")
def sc17_decided(spark, sf):
    """Whether the match is over by sets; a later set that has begun says no."""
    return _boards(spark, sf).select("event_id", S.decided(F.col("sets_a"), F.col("sets_b"), F.col("current"), F.lit(3)).alias("decided"))


@query("SELECT o_orderkey, CASE WHEN a = 6 AND b = 6 THEN false ELSE (greatest(a, b) >= 6 AND abs(a - b) >= 2) OR (greatest(a, b) = 7 AND least(a, b) IN (5, 6)) END AS complete FROM (SELECT o_orderkey, o_orderkey % 9 AS a, o_custkey % 9 AS b FROM orders)")
def sc15_games_complete(spark, sf):
    """A line of games that has a winner; six all is a tie-break still played."""
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 9).alias("a"), (F.col("o_custkey") % 9).alias("b"))
    return rows.select("o_orderkey", F.expr("not (a = 6 and b = 6) and ((greatest(a, b) >= 6 and abs(a - b) >= 2) or (greatest(a, b) = 7 and least(a, b) in (5, 6)))").alias("complete"))


_EVENT_NAME = "concat(CASE p_partkey % 6 WHEN 0 THEN 'ATP ' WHEN 1 THEN 'ITF ' WHEN 2 THEN 'Challenger ' WHEN 3 THEN 'Grand ' WHEN 4 THEN 'WTA women ' ELSE '' END, p_name, CASE p_partkey % 5 WHEN 0 THEN ' Hard' WHEN 1 THEN ' (Red Clay)' WHEN 2 THEN ' GRASS doubles' WHEN 3 THEN ' mixed double' ELSE '' END)"


@query(f"""
WITH t AS (SELECT p_partkey, lower({_EVENT_NAME}) AS t FROM part)
SELECT p_partkey, CASE WHEN contains(t, 'hard') THEN 'hard' WHEN contains(t, 'clay') THEN 'clay' WHEN contains(t, 'grass') THEN 'grass' WHEN contains(t, 'carpet') THEN 'carpet' ELSE 'unknown' END AS surface FROM t
""")
def sc18_surface(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.surface(F.expr(_EVENT_NAME)).alias("surface"))


@query(f"""
WITH t AS (SELECT p_partkey, lower({_EVENT_NAME}) AS t FROM part)
SELECT p_partkey, CASE WHEN contains(t, 'challenger') THEN 'challenger' WHEN regexp_matches(t, 'itf|future') THEN 'itf' WHEN regexp_matches(t, 'atp|wta|grand|masters|slam|premier|international') THEN 'atp_wta' ELSE 'other' END AS level FROM t
""")
def sc20_tour_level(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.level(F.expr(_EVENT_NAME)).alias("level"))


@query(f"""
WITH t AS (SELECT p_partkey, lower({_EVENT_NAME}) AS t FROM part)
SELECT p_partkey, CASE WHEN NOT contains(t, 'double') THEN 'unknown' WHEN contains(t, 'mixed') THEN 'mixed_doubles' WHEN regexp_matches(t, 'women|female|wta') THEN 'womens_doubles'
  WHEN regexp_matches(t, 'men|male|atp') THEN 'mens_doubles' ELSE 'unknown_doubles' END AS discipline FROM t
""")
def sc60_discipline(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.discipline(F.expr(_EVENT_NAME)).alias("discipline"))


# Words of tournament names by surface, in the order in which they are looked for.
SURFACE_WORDS = [("clay", ["roland", "clay"]), ("grass", ["grass", "wimbledon"]), ("carpet", ["carpet"]), ("hard", ["hard", "us open"])]
_WORDS = " ".join(f"WHEN regexp_matches(t, '{'|'.join(w)}') THEN '{s}'" for s, w in SURFACE_WORDS)


@query(f"WITH t AS (SELECT p_partkey, lower({_EVENT_NAME}) AS t, CASE WHEN p_size % 4 = 0 THEN 'grass' END AS known FROM part) SELECT p_partkey, coalesce(known, CASE {_WORDS} ELSE 'hard' END) AS surface FROM t")
def sc26_surface_by_words(spark, sf):
    """A stated surface, else the first surface with a word in the name, else hard."""
    low, found = F.lower(F.expr(_EVENT_NAME)), None
    for name, words in SURFACE_WORDS:
        found = (F if found is None else found).when(low.rlike("|".join(words)), name)
    return table(spark, sf, "part").select("p_partkey", F.coalesce(F.when(F.col("p_size") % 4 == 0, "grass"), found.otherwise("hard")).alias("surface"))


def _latin_sql(x: str) -> str:
    for c, to in N.LATIN.items():
        x = f"replace({x}, '{c}', '{to}')"
    return x


_FOLD = r"trim(regexp_replace(regexp_replace(lower(strip_accents({})), '[^a-zа-я0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, {_FOLD.format('text')} AS folded FROM conversations")
def sc22_fold(spark, sf):
    """Lower case, no accents, no punctuation."""
    return table(spark, sf, "conversations").select("conv_id", "turn", N.fold(F.col("text")).alias("folded"))


_NAME = "CASE p_partkey % 4 WHEN 0 THEN concat('Жданов щербак ', p_name) WHEN 1 THEN concat('van ', p_name, ' ', substr(p_type, 1, 1), '.') WHEN 2 THEN concat(substr(p_type, 1, 1), '. de ', p_name) ELSE substr(p_name, 1, 4) END"


@query(f"SELECT p_partkey, {_latin_sql(_FOLD.format(_NAME))} AS name FROM part")
def sc23_transliterate(spark, sf):
    return table(spark, sf, "part").select("p_partkey", N.latin(N.fold(F.expr(_NAME))).alias("name"))


@query(f"""
WITH n AS (SELECT p_partkey, list_filter(string_split({_latin_sql(_FOLD.format(_NAME))}, ' '), lambda w: w <> '' AND NOT list_contains({N.PARTICLES}, w)) AS w FROM part),
k AS (SELECT *, list_filter(w, lambda x: length(x) > 1) AS long FROM n)
SELECT p_partkey, CASE WHEN len(w) = 0 THEN '' WHEN len(w) >= 2 AND length(w[-1]) = 1 AND len(long) > 0 THEN array_to_string(long, ' ') WHEN len(w) >= 2 AND length(w[1]) = 1 THEN array_to_string(w[2:], ' ') ELSE w[-1] END AS surname,
  CASE WHEN len(w) = 0 THEN '' WHEN len(w) >= 2 AND length(w[-1]) = 1 AND len(long) > 0 THEN list_filter(w, lambda x: length(x) = 1)[1] WHEN len(w) >= 2 AND length(w[1]) = 1 THEN w[1] WHEN len(w) >= 2 THEN w[1][1] ELSE '' END AS initial FROM k
""")
def sc24_surname_and_initial(spark, sf):
    """The key by which names of two sources are compared."""
    rows = table(spark, sf, "part").select("p_partkey", N.latin(N.fold(F.expr(_NAME))).alias("name"))
    return rows.select("p_partkey", N.surname_and_initial(F.col("name")).alias("k")).select("p_partkey", "k.*")


_RAW_NAME = "concat(' ', p_name, CASE WHEN p_partkey % 3 = 0 THEN '  [WC] ' WHEN p_partkey % 3 = 1 THEN ' (1), -' ELSE ' {Q} x.' END)"


@query(f"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim({_RAW_NAME}), '[(\\[{{].*?[)\\]}}]', '', 'g'), '^[ .,-]+|[ .,-]+$', '', 'g'), '\\s+', ' ', 'g') AS name FROM part")
def sc25_clean_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", N.cleaned(F.expr(_RAW_NAME)).alias("name"))


# Spellings of the winning side and of a draw.
SIDE_A, SIDE_B = ["player_a", "team_a", "home", "1", "p1"], ["player_b", "team_b", "away", "2", "p2"]
DRAWS = ["draw", "x", "tie", "push", "ничья"]
_WINNER = "CASE o_orderkey % 7 WHEN 0 THEN ' Home ' WHEN 1 THEN 'p2' WHEN 2 THEN 'Draw' WHEN 3 THEN o_orderstatus WHEN 4 THEN 'O' WHEN 5 THEN '' END"


def _in(xs: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


@query(f"""
WITH w AS (SELECT o_orderkey, o_orderkey % 8 AS a, o_custkey % 8 AS b, coalesce(trim({_WINNER}), '') AS w FROM orders)
SELECT o_orderkey, CASE WHEN lower(w) IN {_in(DRAWS)} THEN NULL WHEN w <> '' AND (lower(w) IN {_in(SIDE_A)} OR w = 'O') THEN 1 WHEN w <> '' AND (lower(w) IN {_in(SIDE_B)} OR w = 'F') THEN 0
  WHEN a > b THEN 1 WHEN a < b THEN 0 END AS label FROM w
""")
def sc39_winner_label(spark, sf):
    """The label from a side's token or name, else from the score; draws have none."""
    won = F.coalesce(F.trim(F.expr(_WINNER)), F.lit(""))
    rows = table(spark, sf, "orders").select("o_orderkey", won.alias("w"), (F.col("o_orderkey") % 8).alias("a"), (F.col("o_custkey") % 8).alias("b"))
    w, low = F.col("w"), F.lower("w")
    label = F.when(low.isin(DRAWS), None).when(low.isin(SIDE_A) | (w == "O"), 1).when(low.isin(SIDE_B) | (w == "F"), 0).when(F.col("a") > F.col("b"), 1).when(F.col("a") < F.col("b"), 0)
    return rows.select("o_orderkey", label.alias("label"))


@query("""
WITH r AS (SELECT vec_id, list_filter([embedding[1]::DOUBLE, CASE WHEN vec_id % 3 > 0 THEN embedding[2]::DOUBLE END, CASE WHEN vec_id % 5 > 0 THEN embedding[3]::DOUBLE END], lambda x: x IS NOT NULL) AS c FROM embeddings)
SELECT vec_id, CAST(len(c) AS INTEGER) AS n, 1 / (1 + exp(-(list_sum(c) / len(c)))) AS prior FROM r
""")
def sc45_mean_logit(spark, sf):
    """The mean of the log odds that are there; absent components do not count."""
    e = lambda i: F.col("embedding")[i].cast("double")
    parts = F.filter(F.array(e(0), F.when(F.col("vec_id") % 3 > 0, e(1)), F.when(F.col("vec_id") % 5 > 0, e(2))), lambda x: x.isNotNull())
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf, "embeddings").select("vec_id", F.size(parts).alias("n"), (1 / (1 + F.exp(-(total / F.size(parts))))).alias("prior"))


@query("SELECT vec_id, abs(embedding[1]::DOUBLE - embedding[2]::DOUBLE) AS spread, (embedding[1]::DOUBLE + embedding[2]::DOUBLE) / 2 AS mean FROM embeddings")
def sc59_symmetric_pair(spark, sf):
    """Mean and range of two partners, the same in either order."""
    a, b = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return table(spark, sf, "embeddings").select("vec_id", F.abs(a - b).alias("spread"), ((a + b) / 2).alias("mean"))


_E = "SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) / 100.0::DOUBLE AS p, 1 + value / 100 AS odds FROM events"


def _events(spark, sf):
    p = F.get_json_object("props", "$.k").cast("int") / F.lit(100.0)
    return table(spark, sf, "events").withColumn("p", p).withColumn("odds", 1 + F.col("value") / 100)


@query(f"SELECT event_type, sum(w * -ln(CASE WHEN y THEN q ELSE 1 - q END)) / sum(w) AS loss FROM (SELECT event_type, value > 200 AS y, least(greatest(p, 1e-6), 1 - 1e-6) AS q, odds AS w FROM ({_E})) GROUP BY 1")
def sc63_weighted_loss(spark, sf):
    q = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = F.sum(F.col("odds") * -F.ln(F.when(F.col("value") > 200, q).otherwise(1 - q))) / F.sum("odds")
    return _events(spark, sf).groupBy("event_type").agg(loss.alias("loss"))


@query(f"SELECT event_id, CASE WHEN c < 0.6 THEN '0.50-0.60' WHEN c < 0.75 THEN '0.60-0.75' ELSE '0.75+' END AS bucket FROM (SELECT event_id, CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS c FROM ({_E}))")
def sc49_confidence_bucket(spark, sf):
    """Buckets of the chosen side's probability."""
    c = F.when(F.col("p") >= 0.5, F.col("p")).otherwise(1 - F.col("p"))
    return _events(spark, sf).select("event_id", F.when(c < 0.6, "0.50-0.60").when(c < 0.75, "0.60-0.75").otherwise("0.75+").alias("bucket"))


@query(f"SELECT event_id, greatest(CASE WHEN odds > 1.5 THEN p * odds - 1 ELSE -1 END, CASE WHEN value < 200 THEN (1 - p) * 2.2 - 1 ELSE -1 END) AS best FROM ({_E})")
def sc4_best_edge(spark, sf):
    """The larger edge of the sides that have a price, else -1."""
    a = F.when(F.col("odds") > 1.5, P.expected_value(F.col("p"), F.col("odds"))).otherwise(-1.0)
    b = F.when(F.col("value") < 200, P.expected_value(1 - F.col("p"), F.lit(2.2))).otherwise(-1.0)
    return _events(spark, sf).select("event_id", F.greatest(a, b).alias("best"))


@query(f"""
WITH m AS (SELECT event_id, p, odds, (1 / odds) / (1 / odds + 0.5) AS fair FROM ({_E}))
SELECT event_id, least(0.74, greatest(0.26, CASE WHEN abs(p - fair) > 0.1 THEN fair + (p - fair) * 0.65 ELSE p END)) AS p_final FROM m
""")
def sc11_shrunk_forecast(spark, sf):
    """A forecast far from the market is drawn towards it, then held within bounds."""
    a, p = 1 / F.col("odds"), F.col("p")
    fair = a / (a + 0.5)
    drawn = F.when(F.abs(p - fair) > 0.1, fair + (p - fair) * 0.65).otherwise(p)
    return _events(spark, sf).select("event_id", F.least(F.lit(0.74), F.greatest(F.lit(0.26), drawn)).alias("p_final"))


@query(f"SELECT event_id, CASE WHEN s > 0 THEN g + 2 * s WHEN s < 0 THEN -(g + 2 * s) ELSE 0 END AS trailing FROM (SELECT event_id, user_id % 7 - 3 AS g, CASE WHEN p > 0.5 THEN -1 WHEN p < 0.5 THEN 1 ELSE 0 END AS s FROM ({_E}))")
def sc13_trailing_favourite(spark, sf):
    """The deficit of the side that the opening price favoured, signed by that side."""
    g, s = F.col("user_id") % 7 - 3, F.when(F.col("p") > 0.5, -1).when(F.col("p") < 0.5, 1).otherwise(0)
    return _events(spark, sf).select("event_id", F.when(s > 0, g + 2 * s).when(s < 0, -(g + 2 * s)).otherwise(0).alias("trailing"))


@query(f"SELECT event_id, CASE WHEN event_type = 'view' THEN CASE WHEN odds > 1.2 THEN odds ELSE 0 END WHEN event_type = 'error' THEN 0 ELSE value END::DOUBLE AS price FROM ({_E})")
def sc58_side_odds(spark, sf):
    """The price of the row's own market; none if it is missing or not valid."""
    own = F.when(F.col("odds") > 1.2, F.col("odds")).otherwise(0.0)
    return _events(spark, sf).select("event_id", F.when(F.col("event_type") == "view", own).when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("price"))


@query(f"SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN p END, (1 / odds) / (1 / odds + 0.5)) AS anchor FROM ({_E})")
def sc57_market_anchor(spark, sf):
    """A given market probability, else the fair share of the prices."""
    a = 1 / F.col("odds")
    return _events(spark, sf).select("event_id", F.coalesce(F.when(F.col("event_type") != "view", F.col("p")), a / (a + 0.5)).alias("anchor"))


@query(f"""
WITH w AS (SELECT conv_id, turn, regexp_extract_all({_FOLD.format('text')}, '[a-z0-9]+') AS w FROM conversations),
k AS (SELECT conv_id, turn, w, list_filter(range(1, len(w) + 1), lambda i: starts_with(w[i], 'th') OR starts_with(w[i], 're')) AS hits FROM w)
SELECT conv_id, turn, len(list_filter(hits, lambda i: len(list_filter(w[greatest(1, i - 4):i + 4], lambda x: contains(x, 'ion'))) > 0)) > 0 AS about FROM k
""")
def sc36_near_words(spark, sf):
    """Whether a keyword stands within four words of a name's token."""
    words = F.regexp_extract_all("folded", F.lit("([a-z0-9]+)"), F.lit(1))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", N.fold(F.col("text")).alias("folded")).withColumn("w", words)
    at = F.transform("w", lambda x, i: F.when(x.startswith("th") | x.startswith("re"), i + 1))
    near = lambda i: F.exists(F.slice("w", F.greatest(F.lit(1), i - 4), i + 4 - F.greatest(F.lit(1), i - 4) + 1), lambda x: x.contains("ion"))
    return rows.select("conv_id", "turn", F.exists(F.filter(at, lambda i: i.isNotNull()), near).alias("about"))


_BET = "CASE o_orderkey % 8 WHEN 0 THEN 'Победа 1' WHEN 1 THEN 'W2' WHEN 2 THEN 'Ф1 (+3.5)' WHEN 3 THEN 'фора 2 -4' WHEN 4 THEN 'ТБ 21.5' WHEN 5 THEN 'меньше 20' WHEN 6 THEN 'anna wins' ELSE 'corner' END"


@query(f"""
WITH t AS (SELECT o_orderkey, lower({_BET}) AS t FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(t, '(^|\\s)(победа 1|w1|п1)(\\s|$)') OR contains(t, 'anna') THEN 'match_winner/p1' WHEN regexp_matches(t, '(^|\\s)(победа 2|w2|п2)(\\s|$)') THEN 'match_winner/p2'
  WHEN regexp_matches(t, 'ф1|фора ?1') THEN 'handicap_games/f1_' || CASE WHEN contains(t, '+') THEN 'plus' ELSE 'minus' END WHEN regexp_matches(t, 'ф2|фора ?2') THEN 'handicap_games/f2_' || CASE WHEN contains(t, '+') THEN 'plus' ELSE 'minus' END
  WHEN regexp_matches(t, 'тб|больше') THEN 'total_games/tb' WHEN regexp_matches(t, 'тм|меньше') THEN 'total_games/tm' ELSE 'other/unknown' END AS market FROM t
""")
def sc37_market_of_text(spark, sf):
    """A bet in free text to market and outcome: winner, handicap, total, in this order."""
    t = F.lower(F.expr(_BET))
    winner = lambda n: t.rlike(rf"(^|\s)(победа {n}|w{n}|п{n})(\s|$)")
    handicap = lambda n: F.concat(F.lit(f"handicap_games/f{n}_"), F.when(t.contains("+"), "plus").otherwise("minus"))
    market = F.when(winner(1) | t.contains("anna"), "match_winner/p1").when(winner(2), "match_winner/p2").when(t.rlike("ф1|фора ?1"), handicap(1)).when(t.rlike("ф2|фора ?2"), handicap(2))
    return table(spark, sf, "orders").select("o_orderkey", market.when(t.rlike("тб|больше"), "total_games/tb").when(t.rlike("тм|меньше"), "total_games/tm").otherwise("other/unknown").alias("market"))


_WHEN = "CASE o_orderkey % 5 WHEN 0 THEN concat('сегодня ', o_custkey % 24, ':05') WHEN 1 THEN 'завтра 12.30' WHEN 2 THEN concat(o_custkey % 28 + 1, ' марта 9:15') WHEN 3 THEN concat(o_custkey % 31 + 1, '.02.24 17:30') ELSE 'вчера' END"
# Genitive names of the months.
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]


@query(f"""
WITH t AS (SELECT o_orderkey, {_WHEN} AS s FROM orders),
u AS (SELECT *, CASE WHEN regexp_matches(s, '^\\d+\\.\\d+\\.\\d+ ') THEN regexp_replace(s, '^\\S+ ', '') ELSE s END AS c, TRY_CAST(regexp_extract(s, '^(\\d+)\\.(\\d+)\\.(\\d+) ', 1) AS INTEGER) AS d, TRY_CAST(regexp_extract(s, '^(\\d+) марта', 1) AS INTEGER) AS m FROM t),
v AS (SELECT *, coalesce(TRY_CAST(regexp_extract(c, '(\\d{{1,2}})[:.](\\d{{2}})', 1) AS INTEGER), 12) AS hh, coalesce(TRY_CAST(regexp_extract(c, '(\\d{{1,2}})[:.](\\d{{2}})', 2) AS INTEGER), 0) AS mi,
  CASE WHEN contains(s, 'сегодня') THEN DATE '2024-01-31' WHEN contains(s, 'завтра') THEN DATE '2024-02-01' WHEN contains(s, 'вчера') THEN DATE '2024-01-30'
  WHEN m IS NOT NULL THEN make_date(2024, 3, m) WHEN d <= 29 THEN make_date(2024, 2, d) ELSE DATE '2024-01-31' END AS day FROM u)
SELECT o_orderkey, strftime(day, '%Y-%m-%d ') || lpad(CAST(hh AS VARCHAR), 2, '0') || ':' || lpad(CAST(mi AS VARCHAR), 2, '0') AS at FROM v
""")
def sc38_local_dates(spark, sf):
    """Words for days, a day with a month's name, or numbers; a day that does not exist gives the day of asking."""
    s, now = F.expr(_WHEN), F.lit("2024-01-31").cast("date")
    clock = F.when(s.rlike(r"^\d+\.\d+\.\d+ "), F.regexp_replace(s, r"^\S+ ", "")).otherwise(s)
    number = lambda x, pattern, i: F.regexp_extract(x, pattern, i).try_cast("int")
    hh = F.coalesce(number(clock, r"(\d{1,2})[:.](\d{2})", 1), F.lit(12))
    mi = F.coalesce(number(clock, r"(\d{1,2})[:.](\d{2})", 2), F.lit(0))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(s, r"^\d+ ([а-я]+)", 1)).cast("int")
    date = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    named = date(F.lit("2024"), month.cast("string"), F.regexp_extract(s, r"^(\d+) ", 1))
    dotted = r"^(\d+)\.(\d+)\.(\d+) "
    numbers = date(F.concat(F.lit("20"), F.regexp_extract(s, dotted, 3)), F.regexp_extract(s, dotted, 2), F.regexp_extract(s, dotted, 1))
    day = F.when(s.contains("сегодня"), now).when(s.contains("завтра"), F.date_add(now, 1)).when(s.contains("вчера"), F.date_add(now, -1)).when(month > 0, F.coalesce(named, now)).otherwise(F.coalesce(numbers, now))
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.date_format(day, "yyyy-MM-dd "), F.lpad(hh.cast("string"), 2, "0"), F.lit(":"), F.lpad(mi.cast("string"), 2, "0")).alias("at"))
