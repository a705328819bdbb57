"""Point histories: from the games of a page or feed to point events with winners, qualities and named gaps.

A source gives games: doc, seq (their order), set_no, tie (a row of a tie-break), a and b (the score
after the game, or in a tie-break after the point), server, states (the texts of the points' scores),
closed (a result of the game is told), told (its winner, where the source names one) and marker (who is
marked as winner of a tie-break point). All rules are column expressions; windows go over one set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A game's scores in their order.
SCORES = ["0", "15", "30", "40", "AD"]
GAMES = "doc, seq, set_no, tie, a, b, server, states, closed, told, marker".split(", ")
_PAIR = r"(?<!\d)(0|15|30|40|A|AD)\s*[:\-]\s*(0|15|30|40|A|AD)(?!\d)"


def point_pair(text: Column) -> Column:
    """struct(a, b): places of a game's score in SCORES, null if the text holds none."""
    up = F.upper(text)
    place = lambda g: F.array_position(F.array(*map(F.lit, SCORES)), F.regexp_replace(F.regexp_extract(up, _PAIR, g), "^A$", "AD")).cast("int") - 1
    return F.when(up.rlike(_PAIR), F.struct(place(1).alias("a"), place(2).alias("b")))


def number_pair(text: Column) -> Column:
    """struct(a, b) of a tie-break's score."""
    pattern = r"^\s*(\d{1,4})\s*:\s*(\d{1,4})\s*$"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).cast("int").alias("a"), F.regexp_extract(text, pattern, 2).cast("int").alias("b")))


def _legal(s: Column) -> Column:
    a, b = s["a"], s["b"]
    return (F.greatest(a, b) <= 2) | ((a == 3) & (b <= 3)) | ((b == 3) & (a <= 3)) | ((a == 4) & (b == 3)) | ((a == 3) & (b == 4))


def point_winner(before: Column, after: Column) -> Column:
    """0 or 1 where one legal point explains both scores of a game, else null."""
    da, db = after["a"] - before["a"], after["b"] - before["b"]
    back = lambda own, x, other: (own == -1) & (x == 4) & (other == 3)  # noqa: E731  advantage lost: the other side's point
    ok = _legal(before) & _legal(after)
    one = F.when((db == 0) & (da == 1), 0).when((da == 0) & (db == 1), 1)
    return F.when(ok & (db == 0) & back(da, before["a"], after["b"]), 1).when(ok & (da == 0) & back(db, before["b"], after["a"]), 0).when(ok, one)


# A game's score as one small number, 5 a + b, and what follows from one or two of them: looked up, not reckoned for every point.
_CODES = [(a, b) for a in range(5) for b in range(5)]


def _won(before: tuple[int, int], after: tuple[int, int]) -> int | None:
    """``point_winner`` of two places."""
    legal = lambda a, b: max(a, b) <= 2 or (a == 3 and b <= 3) or (b == 3 and a <= 3) or (a, b) in ((4, 3), (3, 4))
    if not (legal(*before) and legal(*after)):
        return None
    step = (after[0] - before[0], after[1] - before[1])
    if step == (-1, 0) and before[0] == 4 and after[1] == 3:
        return 1
    if step == (0, -1) and before[1] == 4 and after[0] == 3:
        return 0
    return {(1, 0): 0, (0, 1): 1}.get(step)


def _able(a: int, b: int) -> bool:
    return a == 4 or (a == 3 and b <= 2)


_WON = [_won(x, y) for x in _CODES for y in _CODES]
_CAN = [None if _able(a, b) == _able(b, a) else int(_able(b, a)) for a, b in _CODES]


def _looked_up(values: list, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at)


def point_code(text: Column) -> Column:
    """5 a + b of ``point_pair``; the usual spellings are looked up."""
    usual = [F.lit(x) for a, b in _CODES for n, m in [(SCORES[a], SCORES[b])] for x, y in {(f"{n}:{m}", 0), (f"{n}:{m}".replace("AD", "A"), 0)} for x in (x, 5 * a + b)]
    pair = point_pair(text)
    return F.coalesce(F.try_element_at(F.create_map(*usual), text), pair["a"] * 5 + pair["b"])


def tie_winner(before: Column, after: Column) -> Column:
    a, b = after["a"] - before["a"], after["b"] - before["b"]
    return F.when((a == 1) & (b == 0), 0).when((b == 1) & (a == 0), 1)


def _zero() -> Column:
    return F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))


def shown(s: Column, names: list[str] | None = None) -> Column:
    text = (lambda x: F.get(F.array(*map(F.lit, names)), x)) if names else (lambda x: x.cast("string"))
    return F.concat(text(s["a"]), F.lit(":"), text(s["b"]))


_ROW = ["doc", "seq", "set_no", "i", "before", "after", "server", "winner", "what"]


def _event(i: Column, before: Column, after: Column, winner: Column, what: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), before.alias("before"), after.alias("after"), winner.cast("int").alias("winner"), what.alias("what"))


def _gap(when: Column, reason: str) -> Column:
    none = F.lit(None).cast("string")
    return F.when(when, _event(F.lit(None), none, none, F.lit(None), F.lit(reason)))


def game_events(games: DataFrame, strict: bool) -> DataFrame:
    """Events and gaps of the games that are no tie-break rows.

    ``strict`` sources tell every game's result, so a missing one, and a score that does not follow
    from the one before, are gaps as well.
    """
    rows = games.where("not tie")
    last_game = Window.partitionBy("doc", "set_no").orderBy("seq")
    before = F.struct(F.coalesce(F.lag("a").over(last_game), F.lit(0)).alias("a"), F.coalesce(F.lag("b").over(last_game), F.lit(0)).alias("b"))
    rows = rows.withColumn("done", tie_winner(before, F.struct("a", "b")))
    rows = rows.withColumn("codes", F.transform("states", point_code))
    rows = rows.withColumns({"s": F.array_compact("codes"), "bad": F.size("codes") - F.size(F.array_compact("codes"))})
    score = F.concat("a", F.lit(":"), "b")
    texts = [f"{SCORES[a]}:{SCORES[b]}" for a, b in _CODES]

    def point(after: Column, i: Column) -> Column:
        was = F.when(i == 0, 0).otherwise(F.get("s", i - 1))
        both = was * 25 + after
        return _event(i, _looked_up(texts, was), _looked_up(texts, after), _looked_up(_WON, both), _looked_up(["ambiguous" if w is None else "confirmed" for w in _WON], both))

    n = F.size("s")
    rows = rows.withColumns({"points": F.transform("s", point), "end": F.get("s", n - 1)})
    rows = rows.withColumn("can", _looked_up(_CAN, F.col("end")))
    proved = F.coalesce((F.col("can") == F.col("done")) & (F.col("told").isNull() | (F.col("told") == F.col("can"))), F.lit(False))
    ended = (n > 0) & F.col("closed")
    terminal = F.when(ended & proved, _event(n, _looked_up(texts, F.col("end")), score, F.col("can"), F.lit("terminal_from_game_result")))
    gaps = [_gap(ended & ~proved, "ambiguous_terminal_point"), _gap((n == 0) & (F.lit(True) if strict else F.col("closed")), "point_sequence_missing")]
    if strict:
        gaps += [_gap((n > 0) & ~F.col("closed"), "game_result_missing"), _gap(F.col("done").isNull(), "game_score_transition_missing_or_invalid")]
    else:
        gaps.append(_gap(F.col("bad") > 0, "unrecognized_feed_point"))
    every = F.concat("points", F.array_compact(F.array(terminal, *gaps)))
    return rows.select("doc", "seq", "set_no", "server", F.explode(every).alias("e")).select("doc", "seq", "set_no", "e.i", "e.before", "e.after", "server", "e.winner", "e.what")


def tie_events(games: DataFrame, marked: bool) -> DataFrame:
    """Events and gaps of tie-breaks, and one more for each that reached its end.

    ``marked`` sources mark the winner of a point: another mark than the score's leaves it open.
    """
    rows = games.where("tie")
    states = F.when(F.size("states") > 0, F.transform("states", number_pair)).otherwise(F.array(F.struct("a", "b")))
    rows = rows.select("doc", "seq", "set_no", "server", "marker", F.posexplode(states).alias("i", "s"))
    bad = rows.where("s is null").select("doc", "seq", "set_no", F.lit(None).cast("int").alias("i"), *[F.lit(None).cast("string").alias(c) for c in ("before", "after")], "server", F.lit(None).cast("int").alias("winner"), F.lit("invalid_tiebreak_point_score").alias("what"))
    rows = rows.where("s is not null")
    order = Window.partitionBy("doc", "set_no").orderBy("seq", "i")
    rows = rows.withColumn("was", F.coalesce(F.lag("s").over(order), _zero()))
    won = tie_winner(F.col("was"), F.col("s"))
    rows = rows.withColumn("winner", F.when(won == F.col("marker"), won) if marked else won)
    rows = rows.withColumns({"last": F.lead("seq").over(order).isNull(), "ended": (F.greatest("s.a", "s.b") >= 7) & (F.abs(F.col("s.a") - F.col("s.b")) >= 2)})
    ahead = F.when(F.col("s.a") > F.col("s.b"), 0).otherwise(1)
    final = F.when(F.col("last") & F.col("ended") & F.col("winner").isNotNull(), _event(F.lit(None), shown(F.col("s")), F.when(ahead == 0, "7:6").otherwise("6:7"), ahead, F.lit("terminal_from_tiebreak_result")))
    own = _event(F.col("s.a") + F.col("s.b") - 1, shown(F.col("was")), shown(F.col("s")), F.col("winner"), F.when(F.col("winner").isNull(), "ambiguous").otherwise("confirmed"))
    gap = _gap(F.col("winner").isNull(), "invalid_or_unanchored_tiebreak_transition")
    found = rows.select("doc", "seq", "set_no", "server", F.explode(F.array_compact(F.array(own, gap, final))).alias("e"))
    return found.select("doc", "seq", "set_no", "e.i", "e.before", "e.after", "server", "e.winner", "e.what").union(bad.select(_ROW))


def point_events(games: DataFrame, strict: bool) -> DataFrame:
    """doc, seq, set_no, i, before, after, server, winner, what (an event's quality or a gap's reason)."""
    return game_events(games, strict).select(_ROW).union(tie_events(games, strict).select(_ROW))
