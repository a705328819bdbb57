"""Score scenarios, local search over settings and forecasts from sequences of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prices as P
from ..operators import scenarios, search, sequences
from ..sources.tables import table
from .models import FEATURES, samples
from .registry import query

_SCORES = """SELECT event_id, CAST(hour(ts) % 2 AS INTEGER) AS sa, CAST(event_id // 6 % 2 AS INTEGER) AS sb, CAST(CASE WHEN event_type = 'error' THEN 6 ELSE event_id % 6 END AS INTEGER) AS ga,
  CAST(CASE WHEN event_type = 'error' THEN 6 ELSE user_id % 6 END AS INTEGER) AS gb, CAST(CASE WHEN event_type = 'error' THEN k % 7 WHEN k >= 90 THEN 4 ELSE k % 4 END AS INTEGER) AS pa,
  CAST(CASE WHEN event_type = 'error' THEN k // 7 % 7 WHEN k >= 90 THEN 3 ELSE k // 4 % 4 END AS INTEGER) AS pb, CASE WHEN event_id % 11 = 3 THEN NULL WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS server,
  event_type = 'error' AS tie, CASE WHEN event_type = 'error' AND event_id % 22 <> 3 THEN CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END END AS tbs, CAST(2 + event_id // 12 % 2 AS INTEGER) AS need,
  0.5 + value / 2000 AS p_a, 0.55 + k / 500.0::DOUBLE AS p_b FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""


def scores(spark, sf) -> DataFrame:
    """A legal score of a match for each event, with chances of a point on serve."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    tie = F.col("event_type") == "error"
    n = lambda x, name: x.cast("int").alias(name)
    return e.select(
        "event_id", n(F.hour("ts") % 2, "sets_a"), n(F.floor(F.col("event_id") / 6) % 2, "sets_b"), n(F.when(tie, 6).otherwise(F.col("event_id") % 6), "games_a"),
        n(F.when(tie, 6).otherwise(F.col("user_id") % 6), "games_b"), n(F.when(tie, F.col("k") % 7).when(F.col("k") >= 90, 4).otherwise(F.col("k") % 4), "points_a"),
        n(F.when(tie, F.floor(F.col("k") / 7) % 7).when(F.col("k") >= 90, 3).otherwise(F.floor(F.col("k") / 4) % 4), "points_b"),
        F.when(F.col("event_id") % 11 == 3, None).when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("server"), tie.alias("tiebreak"),
        F.when(tie & (F.col("event_id") % 22 != 3), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b")).alias("tie_server"), n(2 + F.floor(F.col("event_id") / 12) % 2, "need"),
        (0.5 + F.col("value") / 2000).alias("p_a"), (0.55 + F.col("k") / 500.0).alias("p_b"),
    )


_OTHER = "CASE {0} WHEN 'a' THEN 'b' WHEN 'b' THEN 'a' END"
_OVER = "(sa >= need OR sb >= need)"
_FIRST = "coalesce(tbs, server)"


@query(f"""
WITH RECURSIVE e AS ({_SCORES}),
start AS (
  SELECT * REPLACE (coalesce(server, CASE WHEN tie THEN CASE WHEN (CASE WHEN pa + pb = 0 THEN 0 ELSE 1 + (pa + pb - 1) // 2 END) % 2 = 0 THEN tbs ELSE {_OTHER.format('tbs')} END END) AS server) FROM e
), ways AS (
  SELECT *, 1.0::DOUBLE AS chance FROM start WHERE server IS NOT NULL
  UNION ALL SELECT start.* REPLACE (s AS server, coalesce(tbs, s) AS tbs), 0.5::DOUBLE FROM start, (VALUES ('a'), ('b')) v(s) WHERE server IS NULL
), walk AS (
  SELECT 0 AS level, '' AS path, * FROM ways
  UNION ALL
  SELECT level + 1, CASE WHEN {_OVER} THEN path ELSE path || upper(side) END, event_id,
    CASE WHEN {_OVER} THEN sa WHEN set_over THEN sa + (xa > xb)::INT ELSE sa END, CASE WHEN {_OVER} THEN sb WHEN set_over THEN sb + (xb > xa)::INT ELSE sb END,
    CASE WHEN {_OVER} THEN ga WHEN set_over THEN 0 ELSE ya END, CASE WHEN {_OVER} THEN gb WHEN set_over THEN 0 ELSE yb END,
    CASE WHEN {_OVER} THEN pa WHEN set_over OR game_over THEN 0 WHEN NOT tie AND xa >= 3 AND xb >= 3 THEN CASE WHEN xa > xb THEN 4 ELSE 3 END ELSE xa END,
    CASE WHEN {_OVER} THEN pb WHEN set_over OR game_over THEN 0 WHEN NOT tie AND xa >= 3 AND xb >= 3 THEN CASE WHEN xb > xa THEN 4 ELSE 3 END ELSE xb END,
    CASE WHEN {_OVER} THEN server WHEN tie AND set_over THEN {_OTHER.format(_FIRST)} WHEN tie THEN CASE WHEN (1 + (xa + xb - 1) // 2) % 2 = 0 THEN {_FIRST} ELSE {_OTHER.format(_FIRST)} END
      WHEN game_over THEN {_OTHER.format('server')} ELSE server END,
    CASE WHEN {_OVER} THEN tie WHEN set_over THEN false WHEN game_over THEN ya = 6 AND yb = 6 ELSE tie END,
    CASE WHEN {_OVER} THEN tbs WHEN set_over THEN NULL WHEN tie THEN {_FIRST} WHEN game_over THEN CASE WHEN ya = 6 AND yb = 6 THEN {_OTHER.format('server')} END ELSE tbs END,
    need, p_a, p_b, CASE WHEN {_OVER} THEN chance WHEN side = 'a' THEN chance * p ELSE chance * (1 - p) END
  FROM (SELECT *, (tie AND greatest(xa, xb) >= 7 AND abs(xa - xb) >= 2) OR (game_over AND ((greatest(ya, yb) >= 6 AND abs(ya - yb) >= 2) OR (greatest(ya, yb) = 7 AND least(ya, yb) = 6))) AS set_over
    FROM (SELECT *, ga + (game_over AND xa > xb)::INT AS ya, gb + (game_over AND xb > xa)::INT AS yb
      FROM (SELECT *, NOT tie AND greatest(xa, xb) >= 4 AND abs(xa - xb) >= 2 AS game_over
        FROM (SELECT walk.*, side, pa + (side = 'a')::INT AS xa, pb + (side = 'b')::INT AS xb, CASE WHEN server = 'a' THEN p_a ELSE 1 - p_b END AS p
          FROM walk, (VALUES ('a'), ('b')) v(side) WHERE level < 3 AND (side = 'a' OR NOT {_OVER})))))
)
SELECT event_id, sa AS sets_a, sb AS sets_b, ga AS games_a, gb AS games_b, pa AS points_a, pb AS points_b, server, tie AS tiebreak, tbs AS tie_server, sum(chance) AS chance, string_agg(path, '|' ORDER BY path) AS paths
FROM walk WHERE level = 3 GROUP BY ALL
""")
def sc44_point_scenarios(spark, sf):
    """The scores after three more points with their chances and the ways to them."""
    return scenarios.next_points(scores(spark, sf), ["event_id"]).drop("need")


@query()
def sc44_game_scenarios(spark, sf):
    """The scores after two more games with their chances and the ways to them."""
    return scenarios.next_games(scores(spark, sf), ["event_id"]).drop("need")


GRID = {"slope": [0.25, 0.5, 0.75, 1.0, 1.25], "shift": [-0.5, -0.25, 0.0, 0.25, 0.5], "reach": [0.1, 0.35, 1.0, 4.0]}
FIRST = {"slope": 1.0, "shift": 0.0, "reach": 4.0}


def counted_chances(spark, sf) -> DataFrame:
    """How many rows have each outcome at each chance: at most two for each of a hundred chances."""
    return samples(spark, sf).groupBy(F.round("p", 2).alias("p"), "y").agg(F.count("*").alias("n"))


def moved(s: dict) -> Column:
    """A chance moved in its logit: stretched, shifted, and the move held within reach."""
    z = P.clipped_logit(F.col("p"))
    step = z * s["slope"] + s["shift"] - z
    return 1 / (1 + F.exp(-(z + F.greatest(-s["reach"], F.least(s["reach"], step)))))


@query()
def t11_local_search(spark, sf):
    """Every trial of a search by neighbours for the line that loses least: its step, settings and losses, and whether it was adopted."""
    counts = counted_chances(spark, sf).cache()
    trials = search.local_search(FIRST, search.grid_neighbours(GRID), search.evaluator(counts, GRID, moved))
    rows = [(t["step"], search.key(t["settings"]), t["log_loss"], t["brier"], t["adopted"]) for t in trials]
    counts.unpersist()
    return spark.createDataFrame(rows, "step int, settings string, log_loss double, brier double, adopted boolean")


def tapes(spark, sf) -> DataFrame:
    """Events of a user and week as the states of a match, whose outcome is that of most of them."""
    s = samples(spark, sf).withColumn("key", F.col("user_id") * 100 + F.weekofyear("ts"))
    y = s.groupBy("key").agg((F.avg("y") > 0.5).cast("int").alias("y"))
    return s.drop("y").join(y, "key").withColumn("id", F.col("event_id"))


@query()
def u25_sequence_forecasts(spark, sf):
    """A chance at every state of every match from a recurrent model fitted on the first three weeks' matches."""
    packed = sequences.pack(tapes(spark, sf), "key", ["ts", "event_id"], FEATURES)
    model = sequences.fit(packed.where("key % 100 <= 3"), len(FEATURES), epochs=10)
    return model.forecasts(packed).select(F.col("key").alias("match_id"), F.col("id").alias("event_id"), "p")
