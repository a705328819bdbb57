"""Score text and score boards as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prices import set_winner


def pairs(text: Column, separator: str = "-") -> Column:
    """The number pairs of a score text, in order: array of struct(a, b)."""
    found = F.regexp_extract_all(text, F.lit(rf"(\d+\s*[{separator}]\s*\d+)"), F.lit(1))
    number = lambda p, i: F.regexp_extract(p, r"(\d+)\D+(\d+)", i).cast("int")
    return F.transform(found, lambda p: F.struct(number(p, 1).alias("a"), number(p, 2).alias("b")))


def plain_pairs(text: Column) -> Column:
    """Pairs after the tie-break points in brackets are gone."""
    return pairs(F.regexp_replace(text, r"[\[(]\s*\d+\s*[\])]", ""))


def wins(games: Column, side: str) -> Column:
    other = "b" if side == "a" else "a"
    return F.size(F.filter(games, lambda g: g[side] > g[other]))


def set_tally(text: Column) -> Column:
    """Sets of both sides: struct(a, b). One small pair is a tally itself; null if no set is won."""
    g = pairs(text)
    single = (F.size(g) == 1) & (F.get(g, F.lit(0))["a"] <= 5) & (F.get(g, F.lit(0))["b"] <= 5)
    a, b = wins(g, "a"), wins(g, "b")
    counted = F.struct(a.alias("a"), b.alias("b"))
    return F.when(single, F.get(g, F.lit(0))).when(a + b > 0, counted)


def winners_in_brackets(text: Column) -> Column:
    """Set winners of a text such as ``0:2 (3-6 4-6)``, up to the first set that is not a finished one."""
    inside = pairs(F.regexp_extract(text, r"\((.*)\)", 1), "-:")
    won = F.transform(inside, lambda g: F.coalesce(set_winner(g["a"], g["b"]), F.lit("")))
    first_open = F.array_position(won, "")
    return F.slice(won, F.lit(1), F.when(first_open == 0, F.size(won)).otherwise(first_open - 1).cast("int"))


def scores_agree(left: Column, right: Column) -> Column:
    """Equal pairs, or one side is the tally (either way round) of the other's two sets or more."""
    a, b = plain_pairs(left), plain_pairs(right)

    def tally_of(summary: Column, detail: Column) -> Column:
        s, won, lost = F.get(summary, F.lit(0)), wins(detail, "a"), wins(detail, "b")
        return (F.size(summary) == 1) & (F.size(detail) >= 2) & (((s["a"] == won) & (s["b"] == lost)) | ((s["a"] == lost) & (s["b"] == won)))

    return (F.size(a) > 0) & (F.size(b) > 0) & ((a == b) | tally_of(a, b) | tally_of(b, a))


def board(lines: Column) -> Column:
    """Sets won on the closed lines and games of the live one: the first marked live, else the last."""
    marked = F.array_position(F.transform(lines, lambda x: F.coalesce(x["live"], F.lit(False))), True)
    live = F.when(marked > 0, marked).otherwise(F.size(lines)).cast("int")
    closed = F.filter(lines, lambda x, i: i + 1 != live)
    line = F.get(lines, live - 1)
    won = lambda x, y: F.size(F.filter(closed, lambda g: F.coalesce(g[x], F.lit(0)) > F.coalesce(g[y], F.lit(0))))
    games = lambda c: F.coalesce(line[c], F.lit(0)).alias(c)
    return F.struct(won("games_a", "games_b").alias("sets_a"), won("games_b", "games_a").alias("sets_b"), games("games_a"), games("games_b"))


def decided(sets_a: Column, sets_b: Column, current: Column, lines: Column) -> Column:
    """Whether a side has the sets it needs: three where the score shows a best of five."""
    five = (current >= 4) | ((sets_a >= 2) & (sets_b >= 2)) | (lines >= 4)
    return (F.greatest(sets_a, sets_b) >= F.when(five, 3).otherwise(2)) & (current <= sets_a + sets_b)


def surface(text: Column) -> Column:
    low, out = F.lower(F.trim(text)), None
    for name in ("hard", "clay", "grass", "carpet"):
        out = (F if out is None else out).when(low.contains(name), name)
    return out.otherwise("unknown")


def level(text: Column) -> Column:
    low = F.lower(F.trim(text))
    out = F.when(low.contains("challenger"), "challenger").when(low.rlike("itf|future") | low.isin("f", "15", "25"), "itf")
    return out.when(low.rlike("atp|wta|grand|masters|slam|premier|international"), "atp_wta").otherwise("other")


def discipline(text: Column) -> Column:
    """Only explicit facts count; the women's words are looked for before the men's."""
    low = F.lower(text)
    out = F.when(~low.rlike("double|пары|парный"), "unknown").when(low.rlike("mixed|смешан"), "mixed_doubles")
    return out.when(low.rlike("women|female|wta|жен"), "womens_doubles").when(low.rlike("men|male|atp|муж"), "mens_doubles").otherwise("unknown_doubles")
